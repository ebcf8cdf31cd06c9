"""Each operator against a brute-force version on small, odd tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, jaccard, lp, neighbours, packing, pieces, private, quality, repeats, urls, warc
from corpusmill.llm.op01 import tokenizer_spec
from corpusmill.llm.op07 import model_bytes

R = random.Random(11)
WORDS = ["la", "der", "thing", "ü", "漢字", "a,b", "ΣΑΣ", "x.", "<|endoftext|>"]
PASSAGE = " ".join(R.choice("abcdefghij") * R.randint(1, 6) for _ in range(150))


def prose(n: int) -> str:
    return " ".join(R.choice(WORDS) + R.choice("abcdefgh") * R.randint(0, 4) for _ in range(n))


def odd_texts() -> list[str | None]:
    base = prose(200)
    changed = base.split(" ")
    changed[40] = "other"
    return [
        None, "", " \n\t", "one two", "one two", base, base, " ".join(changed), prose(30) + PASSAGE + prose(30),
        PASSAGE + "é", "aaaa" * 600, "ab" * 700 + PASSAGE, "x" * 399, "long " * 3000, prose(2500),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", f"block{i}") for i, t in enumerate(odd_texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, block string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(docs) -> list[tuple[int, str]]:
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# packing


def test_pieces_hold_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    spec = tokenizer_spec()
    tokenizer = Tokenizer.from_str(spec)
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts_of(docs)}
    got = packing.pack(docs, spec, size=256).toPandas()
    assert packing.pack(empty, spec, size=256).count() == 0
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in texts_of(docs))
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 256


def test_sequences_hold_the_ids(docs):
    from tokenizers import Tokenizer

    spec = tokenizer_spec()
    tokenizer = Tokenizer.from_str(spec)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(docs)}
    pieces_of = packing.pack(docs, spec, size=256).persist()
    want: dict[int, list[int]] = {}
    for r in sorted(pieces_of.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == part
        want.setdefault(r["sequence_id"], []).extend(part)
    got = {r["sequence_id"]: r for r in packing.sequences(pieces_of, 256, pad_id=7).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want[k] + [7] * (256 - len(want[k]))
        assert sum(r["lengths"]) == len(want[k])


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    spec = tokenizer_spec()
    encoder, tokenizer = packing.Encoder(spec), Tokenizer.from_str(spec)
    marks = list("abcTHEésß漢😀.,'0189#\x00\x02\x1c\x0b\x85 \n\ŕΣİſ") + ["'s", "<|endoftext|>", "the"]
    for _ in range(3000):
        text = "".join(R.choice(marks) for _ in range(R.randint(0, 20)))
        assert encoder(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_spells_all_new_words_of_a_call_at_once(monkeypatch):
    import tiktoken
    from tokenizers import Tokenizer

    calls, draw = [], random.Random(5)
    for name in ("_encode_single_piece", "encode_ordinary"):
        was = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, was=was: calls.append(1) or was(self, text))
    spec = tokenizer_spec()
    encoder, tokenizer = packing.Encoder(spec), Tokenizer.from_str(spec)
    marks = list("abcTHEésß漢😀.,'0189#\x1c\x0b\x85\u2028½ǅ \n\ŕΣİſ") + ["'s", "'RE", "'ve", "'ll", "'d", "the"]
    texts = ["", "'", "it's'", *["".join(draw.choice(marks) for _ in range(draw.randint(0, 60))) for _ in range(400)]]
    for text in (" ".join(texts), "x\0y z", "a <|endoftext|>b"):
        calls.clear()
        assert encoder(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(calls) <= 2
    assert [x.tolist() for x in encoder.many(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_uses_demand_exactly_with_little_waste():
    sizes, demand = np.array([1, 7, 60, 130, 500, 900, 1500]), np.array([900, 300, 40, 200, 77, 120, 60])
    plan = lp.whole_plan(sizes, demand, 2048)
    assert (sum(p * n for p, n in plan) == demand).all() and all(p @ sizes <= 2048 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * (sizes @ demand) / 2048 + 2


# repeats


@pytest.mark.parametrize("size", [400, 300])
def test_removed_bytes(docs, empty, size):
    texts = [t.encode() for _, t in texts_of(docs)]
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - size + 1):
            seen[t[k : k + size]] = seen.get(t[k : k + size], 0) + 1
    want = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = True
        left = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        want.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    got = repeats.removed(docs, size=size).toPandas()
    assert sorted(map(tuple, got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False))) == sorted(want)
    assert repeats.removed(empty, size=size).count() == 0


# similar texts


def test_links_and_groups(spark, docs, empty):
    base = [f"w{i}" for i in range(120)]
    copies = [(100 + k, " ".join(base[:k] + [f"v{k}"] + base[k + 1 :]), "", "") for k in range(0, 90, 3)]
    table = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    rows = texts_of(table)
    first: dict[tuple, int] = {}
    for i, t in sorted(rows):
        first.setdefault(tuple(words_of(t)), i)
    sets = {i: {w[k : k + 5] for k in range(len(w) - 4)} or ({w} if w else set()) for w, i in first.items()}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}

    def root(i: int) -> int:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        return min(reach)

    want = sorted((i, c, len(links[c]), root(c), root(c) == i) for i, t in rows for c in [first[tuple(words_of(t))]])
    assert sorted(map(tuple, jaccard.similar(table).collect())) == want
    assert any(n > 5 for _, _, n, _, _ in want)
    assert jaccard.similar(empty).count() == 0


def test_depth_is_shortened_to_the_recall():
    depth = jaccard.shortened(np.zeros(jaccard.DEEPEST + 1), jaccard.DEEPEST, 0.8, 0.9999)
    assert jaccard.recall(0.8, depth) >= 0.9999 > jaccard.recall(0.8, depth + 1)


# url rules


def test_automaton_against_plain_matching(spark):
    rules = [urls.Rule("block", f"h{i}.org", f"/p{i}/*x") for i in range(40)] + [urls.Rule("allow", "org", "/"), urls.Rule("block", "*.com", "/a")]
    rows = ["", "org/", "http://ORG", "http://a.org/x", "s://h3.org/p3/zzx?q", "s://b.h3.org/p3/x", "s://xh3.org/p3/x", "s://e.net/a.org/", "s://x.y.com/ab", None, "s://" + "a" * 9000 + ".org/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    none, org = (None, "allow"), ("org/", "allow")
    h3 = ("h3.org/p3/*x", "block")
    assert [got[i] for i in range(len(rows))] == [none, none, none, org, h3, h3, org, none, ("*.com/a", "block"), none, org]
    assert urls.judge(df.where("false"), rules).count() == 0


# quality


def test_base_figures(docs):
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    for i, t in texts_of(docs):
        w, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        inside = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)} if len(w) < 1000 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        if inside is not None:
            assert r["n_repeat_words"] == len(inside)
        assert r["kept"] == (not r["base_failed"])


def test_classifier_on_held_out_rows(spark):
    rows = [(i, prose(60) if i % 2 else " ".join(w + R.choice(["###", "$$$", "%%%"]) for w in prose(60).split(" "))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality.judge(table, quality.train(table, labels)).where("doc_id >= 200 AND NOT base_failed").collect()
    assert sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in got) >= 0.97 * len(got)
    assert quality.train(table, labels.where("false")) is None


def test_scores_do_not_depend_on_other_texts():
    weights = np.random.default_rng(4).standard_normal(quality.FEATURES)
    texts = [t.encode() for t in ("ab", "", "one two", "x\ny z", "漢字 a", "abc", "the last one")]
    alone = [quality.scores(quality.Joined([t]), weights)[0] for t in texts]
    assert np.allclose(quality.scores(quality.Joined(texts), weights), alone, rtol=0, atol=1e-12)


# chat


def test_windows_round_trip(spark):
    rows = [(1, k, R.choice(["user", "assistant", "a:b"]), R.choice(["\\l </turn>\n### user: x", "#" * 5, prose(40), "", None])) for k in range(60)]
    rows += [(2, 0, "system", "be brief"), (3, None, None, "x"), (3, 0, "system", "late"), (3, 1, "assistant", prose(900)), (4, 0, "system", "s")]
    rows += [(4, k + 1, ("user", "assistant")[k % 2], prose(50)) for k in range(20)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(table, budget=700, history=300)
    got = {r["conv_id"]: r for r in chat.digest_windows(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1]))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    last = windows.where("conv_id = 4").orderBy(F.desc("window")).first()
    assert last["window"] > 0 and last["formatted"].startswith("### system: s</turn>") and last["n_repeated"] > 1
    assert chat.digest_windows(chat.format_windows(table.where("false"))).count() == 0


# pieces


def test_transducer_equals_sentencepiece(docs, empty):
    import public_tokenizers
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    machine = pieces.Transducer(model_bytes())
    marks = list("abcdeint   \n\tABé▁ß漢字😀.,0123<>#́\x00") + ["the", "ing", " " * 30, "<0x41>"]
    for _ in range(4000):
        text = "".join(R.choice(marks) for _ in range(R.randint(0, 25)))
        ids = processor.encode(text)
        assert machine.encode(text).tolist() == ids and machine.decode(np.array(ids, dtype=np.int64)) == processor.decode(ids)
    got = pieces.digests(docs, model_bytes()).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    assert {(r["doc_id"], r["n_ids"]) for r in got} == {(i, len(processor.encode(t))) for i, t in texts_of(docs)}
    assert pieces.digests(empty, model_bytes()).count() == 0
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), model_bytes()), model_bytes())
    assert {tuple(r) for r in back.collect()} == set(texts_of(docs))


# warc


def test_archives_read_back(spark, tmp_path):
    bodies = ["", None, "a\r\n\r\nb", "\r\n", "x\r", "é" * 5000, "a\r\n\r\nb", "\r\n\r\n", "same", "same", "WARC/1.0\r\n\r\n"]
    rows = [(len(bodies) - i, f"http://h/{i} x" if i % 3 else None, b, "clash") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = warc.archive_pages(pages.repartition(3), path=str(tmp_path / "w"))
    got = {r["source_id"]: r for r in warc.read_warc(spark, path).collect()}
    for i, _, b, _ in rows:
        payload = (b or "").encode()
        first = min(j for j, _, c, _ in rows if (c or "") == (b or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert first != i or bytes(r["payload"]) == payload
    assert warc.read_warc(spark, warc.archive_pages(pages.where("false"))).count() == 0


def test_both_arc_versions(spark, tmp_path):
    one = b"http://a/ 1.2.3.4 19990102030405 text/html 5\nab\ncd\n"
    two = b"http://b/ 1.2.3.4 19990102030405 text/html 200 - - 7 f.arc 3\nxyz\n"
    (tmp_path / "x.arc").write_bytes(b"filedesc://x 0.0.0.0 19990101000000 text/plain 4\n1 0\n\n" + one + b"\n" + two)
    got = sorted(bytes(r["arc"]) for r in warc.read_arc(spark, str(tmp_path)).collect())
    assert [warc.parse_arc(x)[1] for x in got] == [b"ab\ncd", b"xyz"]
    record = warc.to_warc(got[0], 4, 4)
    assert b"WARC-Type: response" in record and b"WARC-Date: 1999-01-02T03:04:05Z" in record
    with pytest.raises(warc.BadRecord):
        warc.parse_arc(b"http://a/ 1.2.3.4 text/html 5\nabcde")


# vectors


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.standard_normal(16) * (0.15 if i < 200 else 3)]) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [1.0]), (1006, [2.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, b in good.items() if j != i and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9} for i, a in good.items()}
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(reach), min(reach) == i)
    assert neighbours.near_duplicates(table.where("false")).count() == 0


def test_links_between_clumps_with_full_lists(spark, monkeypatch):
    rng = np.random.default_rng(5)
    first = rng.standard_normal(64)
    first /= np.linalg.norm(first)
    side = rng.standard_normal(64)
    side -= (side @ first) * first
    second = 0.93 * first + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side)
    good = np.array([c + 0.005 * rng.standard_normal(64) for c in (first, second) for _ in range(40)], dtype=np.float32).astype(float)
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert links.min() == 79  # every pair is a link
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(good)], "vec_id long, embedding array<float>")
    for chunk in (neighbours.CHUNK, 16):  # a bucket at once, and in blocks
        monkeypatch.setattr(neighbours, "CHUNK", chunk)
        got = neighbours.near_duplicates(table).collect()
        assert {tuple(r) for r in got} == {(i, 79, 0, i == 0) for i in range(80)}


def test_audit_weighs_groups_alike_and_is_followed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((21, 64))
    hot = [(i, centres[0] + 0.02 * rng.standard_normal(64)) for i in range(100)]
    pairs = [(100 + i, centres[1 + i // 2] + 0.02 * rng.standard_normal(64)) for i in range(40)]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in hot + pairs], "vec_id long, embedding array<float>")
    raw, dtype = neighbours.distinct_vectors(table, "vec_id", "embedding")
    only_hot = spark.createDataFrame([(i, 0) for i in range(100)], "id long, root long")
    # 9,900 of 9,940 links, but none of 20 pairs: two vectors of each are groups of their own here
    assert neighbours.audit(raw, dtype, only_hot, 0.9) == pytest.approx(1 / 41)
    monkeypatch.setattr(neighbours, "AUDITS", 1)
    monkeypatch.setattr(neighbours, "descended", lambda table, *_: table.selectExpr("id AS u", "id AS v", "0D AS sim", "true AS link").where("false"))
    want = {(i, 99, 0, i == 0) for i in range(100)} | {(100 + i, 1, 100 + i // 2 * 2, i % 2 == 0) for i in range(40)}
    assert {tuple(r) for r in neighbours.near_duplicates(table).collect()} == want


# pseudonyms


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, docs):
    values = {
        "email": "Ann.Lee9@mail.example.com", "phone": "+1 (743) 555-3824", "ipv4": "192.168.4.77", "card": "4111 1111 1111 1111",
        "bad card": "4111111111111112", "ssn": "219-09-9999", "date": "1984-02-29", "day": "29/02/2000", "no date": "1983-02-29",
        "iban": "GB82WEST12345698765432", "secret": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "plain": "version 1.2 of 2024",
    }
    rows = [(i, f"{k}: {v}, again {v}!") for i, (k, v) in enumerate(values.items())] + [(99, None), (100, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in private.pseudonymise(table, "k").collect()}
    other = {r["doc_id"]: r["text"] for r in private.pseudonymise(table, "l").collect()}
    for i, (kind, value) in enumerate(values.items()):
        text = got[i]["text"]
        if kind in ("bad card", "no date", "plain"):
            assert text == rows[i][1] and got[i]["n_private"] == 0
            continue
        one, two = re.fullmatch(rf"{kind}: (.*), again (.*)!", text).groups()
        shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", x)))
        assert one == two != value and value not in text and other[i] != text and got[i]["n_private"] == 2
        if kind not in ("ipv4", "secret"):
            assert shape(one) == shape(value)
        if kind == "card":
            assert luhn(re.sub(" ", "", one))
        if kind == "iban":
            assert int("".join(str(int(c, 36)) for c in one[4:] + one[:4])) % 97 == 1
    assert got[99]["text"] is None and got[100]["text"] == ""
    assert private.pseudonymise(docs.where("false"), "k").count() == 0


def test_values_beside_others_are_found(spark):
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    rows = [
        f"card {card} 12/27", "pay 4111111111111111 123.", f"12 {card}", f"n {card} 5500 0000 0000 0004 x", f"{card} 1984-02-29",
        f"to {iban} NOW", "GB82WEST12345698765432", "юрий@mail.example.com", "a" * 70 + "@mail.example.com", "1 2 3 4", f"is {card}",
    ]
    got = [r for r in private.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    text = [r["text"] for r in got]
    assert [r["n_private"] for r in got] == [1, 1, 1, 2, 2, 1, 1, 1, 1, 0, 1]
    new = text[10][3:]
    assert luhn(new.replace(" ", "")) and new != card
    assert text[:3] == [f"card {new} 12/27", f"pay {new.replace(' ', '')} 123.", f"12 {new}"]
    assert text[3].startswith(f"n {new} ") and text[3].endswith(" x") and "5500 0000 0000 0004" not in text[3]
    assert text[4].startswith(f"{new} ") and "1984-02-29" not in text[4]
    assert text[5].startswith("to GB") and text[5].endswith(" NOW") and text[5][3:-4].replace(" ", "") == text[6] != rows[6]
    assert "юрий" not in text[7] and text[7].endswith("@mail.example.com") and "aaaaa" not in text[8] and text[9] == rows[9]


def test_network_is_a_permutation(spark):
    radices = F.array(*[F.lit(x).cast("bigint") for x in (7, 5, 3)])
    rows = spark.range(105).select(F.array(F.col("id") % 7, F.floor(F.col("id") / 7) % 5, F.floor(F.col("id") / 35)).alias("v"))
    got = {tuple(r[0]) for r in rows.select(private.permuted(F.col("v"), radices, F.lit("t"), "k")).collect()}
    assert got == {(a, b, c) for a in range(7) for b in range(5) for c in range(3)}


# pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(80 + i), "en", "s", 1) for i in range(30)]
    rows += [(50, rows[3][1], "en", "s", 1), (51, rows[4][1] + " mail bob77@example.com", "en", "s", 1), (52, "short", "en", "s", 1)]
    rows += [(60, prose(40) + " " + PASSAGE, None, None, None), (61, PASSAGE + " " + prose(40), "en", "s", 1), (None, prose(60), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "t")
        assert found.columns == docs.columns, name
        docs = found
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {*range(30), 60, 61, None}
    assert len(left[60]) < 400 and len(left[61]) < 400 and "bob77" not in " ".join(left.values())
    pieces_of = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert pieces_of["doc_tokens"].gt(0).all() and set(pieces_of["doc_id"].dropna()) == {*range(30), 60, 61}
