"""Text operators over whole texts, against plain versions of the same."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.plans import catalog

#: Characters by what they are read as.
SAME = [("'", "‘’‚‛′"), ('"', "“”„″"), ("-", "‐‑‒–—−"), ("...", "…")]
LONE = "•·◦▪▫■□●○‣⁃∙*¢°\ufffd"


def normal(t):
    """Word by word: each character is looked up, a word that is one bullet alone goes."""
    folded = []
    for c in unicodedata.normalize("NFKC", t):
        folded.append(next((plain for plain, forms in SAME if c in forms), c))
    return " ".join(word.lower() for word in "".join(folded).split() if not (len(word) == 1 and word in LONE))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rate(a, b, whole):
    return edits(a, b) / len(a) if whole else float(bool(b))


def f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a or b else 1.0


def test_scores_of_whole_turns(spark, tmp_path):
    long = "the same words again and again, " * 8
    turns = [long + "“Größe” – ﬁn", long + '"grosse" - fin de año', "• été\u00a0là", "ete la", "", "*", "x" * 300, "x" * 150 + "y" * 150]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {name: {r["turn"]: r[-1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("cer_whole", "wer_whole", "word_f1_whole")}
    for i, (a, b) in enumerate(zip(map(normal, turns), map(normal, turns[1:]), strict=False)):
        assert got["cer_whole"][i] == pytest.approx(rate(a, b, a), abs=1e-6)
        assert got["wer_whole"][i] == pytest.approx(rate(a.split(" "), b.split(" "), a) if a else float(bool(b)), abs=1e-6)
        assert got["word_f1_whole"][i] == pytest.approx(f1(a, b), abs=1e-6)


def test_normalize_whole(spark, tmp_path):
    texts = ["“Größe” – ﬁn… • ein ∙ Punkt ☐", "word " * 300 + "‘last’ − * ½ Ａ", "", None, "a\u00a0\u2003b\tc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["normal"] for r in catalog.text_normalize_whole(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else normal(t) for i, t in enumerate(texts)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["normal"] for r in catalog.text_normalize_whole(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: None if r["text"] is None else normal(r["text"]) for r in docs}


def test_greedy_wrap(spark):
    """Every word is wrapped, far past the 80th too."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_lines"] for r in catalog.greedy_wrap(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys() and max(len(t.split()) for t in texts.values() if t) > 80
    for i, t in texts.items():
        used = lines = 0
        for word in [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w] if t is not None else []:
            if used and used + 1 + len(word) <= 40:
                used += 1 + len(word)
            else:
                lines += -(-len(word) // 40)
                used = (len(word) - 1) % 40 + 1
        assert got[i] == (None if t is None else lines)


def test_more_words_than_code_units(spark):
    """Every word of a pair has a character of its own, past the 55,000th (surrogates) and the 65,000th (one code unit) too."""
    codes = spark.range(1, 80_001).select(text.word_code(F.col("id")).alias("c"))
    assert codes.distinct().count() == codes.filter("length(c) = 1").count() == 80_000
    ends = spark.createDataFrame([(1,), (0xD800 - 0x100,), (0xD800 - 0xFF,), (0xFEFF - 0x900,), (0xFEFF - 0x8FF,), (0x10FFFF - 0x900,)], "id bigint").select(text.word_code(F.col("id")))
    assert [ord(r[0]) for r in ends.collect()] == [0x100, 0xD7FF, 0xE000, 0xFEFE, 0xFF00, 0x10FFFF]
