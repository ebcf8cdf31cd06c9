"""Own fixture games, with captures, and variants of them."""


def written(moves, result, **tags):
    lines = [f'[{name} "{value}"]' for name, value in tags.items()]
    return "\n".join(lines) + f'\n[Result "{result}"]\n\n{moves} {result}\n'


OPEN_GAME = "1. e4 e5 2. Nf3 d6 3. Bc4 Nc6 4. d4 exd4 5. Nxd4 Nxd4 6. O-O Nc6 7. Nc3 Nf6 8. Re1 Be7 9. Bg5 O-O 10. Bxf6 Bxf6"
QUIET_GAME = "1. c4 e6 2. Nc3 d5 3. cxd5 exd5 4. d4 c6 5. Bf4 Bd6 6. Bxd6 Qxd6 7. e3 Nf6 8. Bd3 O-O 9. Nge2 Re8 10. O-O Nbd7"
PAWN_GAME = "1. d4 d5 2. c4 dxc4 3. e3 e5 4. Bxc4 exd4 5. exd4 Nf6 6. Nf3 Be7 7. O-O O-O 8. h3 Nbd7 9. Nc3 Nb6 10. Bb3 Nbd5"
SHORT_GAME = "1. b3 e5 2. Bb2 Nc6 3. e3 d5 4. Bb5 Bd6 5. Bxc6 bxc6 6. d3 Nf6 7. Nd2 O-O 8. Ngf3 Bg4"
CLUB = {"Termination": "Normal", "Date": "2023.05.06", "Round": "4"}

LICHESS = "\n".join(
    [
        written(OPEN_GAME, "1-0", Event="Rated Blitz game", Site="club/open", White="Ash", Black="Birch", WhiteElo=1810, BlackElo=1925, **CLUB),
        written(QUIET_GAME, "0-1", Event="Rated Classical game", Site="club/quiet", White="Cedar", Black="Elm", WhiteElo=1985, BlackElo=1840, **CLUB),
    ]
)
LC0 = "\n".join(
    [
        written(PAWN_GAME, "1-0", Event="Engine match", Site="lab", Date="2023.05.07", Round="1", White="Fir", Black="Hazel", WhiteElo=2100, BlackElo=2100),
        written(SHORT_GAME, "1/2-1/2", Event="Engine match", Site="lab", Date="2023.05.07", Round="2", White="Hazel", Black="Fir", WhiteElo=2100, BlackElo=2100),
    ]
)


def rated(white="1850", black="1900", termination="Normal", event="Rated Blitz game", result="1-0", moves="1. e4 e5 1-0", extra=""):
    tags = [("Event", event), ("Result", result)]
    tags += [(n, v) for n, v in (("WhiteElo", white), ("BlackElo", black), ("Termination", termination)) if v is not None]
    return "\n".join(f'[{n} "{v}"]' for n, v in tags) + extra + f"\n\n{moves}\n"
