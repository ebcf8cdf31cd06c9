"""The pipeline's passages: over 50 words that stand in several documents."""

from __future__ import annotations

import random

R = random.Random(17)
SYLLABLES = "la ne to vi du ka re so mi ha ou en der é ü ñ x".split()


def words(n: int) -> str:
    return " ".join("".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 3))) + R.choice(["", "", "", ".", ","]) for _ in range(n))


def test_passages_of_over_50_words_go_and_shorter_ones_stay(spark, tmp_path):
    import corpus_pipeline

    long = [words(n) for n in range(51, 61)]
    short = [words(n) for n in (20, 30, 35, 40)]
    assert min(len(p.encode()) for p in long) < 400
    rows, inside, clean = [], {}, {}
    for k in range(60):
        passage = long[k % 10] if k < 40 else short[k % 4]
        before, after = words(R.randint(60, 120)), words(R.randint(60, 120))
        (inside if k < 40 else clean)[k] = (before, passage, after)
        rows.append((k, f"{before} {passage} {after}", "en"))
    for k in range(60, 120):
        clean[k] = (words(150),)
        rows.append((k, clean[k][0], "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stage = dict(corpus_pipeline.STAGES)["suffix-array dedup"]
    left = {r["doc_id"]: r["text"] for r in stage(spark, docs, str(tmp_path)).collect()}
    assert len(left) == len(rows)
    for k, (before, passage, after) in inside.items():
        # letters next to the passage may be alike by chance
        assert passage not in left[k] and before[:-20] in left[k] and after[20:] in left[k]
        assert len(left[k]) < len(before) + len(after) + 10
    assert all(left[k] == " ".join(parts) for k, parts in clean.items())


def test_runs_with_few_words_stay(spark):
    from corpusmill.llm.repeats import removed

    link = "http://" + "abcdefghij" * 60
    docs = spark.createDataFrame([(1, "one " + link + " two"), (2, "three " + link + " four")], "doc_id long, text string")
    assert [r["n_removed"] > 0 for r in removed(docs).collect()] == [True, True]
    assert [r["n_removed"] for r in removed(docs, words=5).collect()] == [0, 0]
