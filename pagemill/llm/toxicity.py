"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are words of an insult lexicon in four languages, phrases, typing patterns, and words and word stems learned from labelled
rows. Each fires or abstains; one more votes clean where no other fires. The label model takes the true label as hidden: for two voters that err independently
given the label, the covariance of firing is ``d_i d_j p (1 - p)``, where d is a voter's rate on toxic minus that on clean
documents and p the share of toxic ones, so triplets of covariances give every d without labels. What a pair covaries
beyond that, given the label, is its correlation; correlated voters share their evidence. The covariances come from one pass over
all documents in which each task adds up a matrix of fixed size.

Posterior labels of a bounded sample of labelled training rows (``MAX_FIT``, smallest hash first) come from the voters and
the given label, itself a voter whose error rates are estimated. A logistic regression on counts of words and stems chosen
on the same rows, on the length and on the voters is fitted to them. Labels, lang, source and doc_id are no
input of a score. Rows whose crc32(doc_id) modulo 4 is 2 are held out of everything that reads labels.

Defined results: null and empty texts have no words, and of the voters only the one for clean fires on them; a null doc_id is not held out and has no label;
several labels of one document count by their mean; rows that repeat a labelled doc_id are in the sample once for each different text, within its bound;
without labels the voters alone decide; repeated rows are scored alike; other columns don't matter, whatever their names; an empty table gives an empty table. Texts are read whole, in pieces of about a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.minhash import _BYTE, _IN_WORD, mixed
from pagemill.llm.shared import raw_texts, received, sent, slices, staged

#: The insult lexicon, one voter a word.
LEXICON = (
    "idiot idiots stupid moron morons scum trash worthless pathetic disgusting loser losers clown clowns garbage filthy vermin imbecile cretin dumb dumbass "
    "bastard bastards bitch asshole shit fuck fucking whore slut retard retarded jerk "
    "idiote connard salope abruti crétin dummkopf arschloch scheiße abschaum trottel idiota estúpido imbécil basura mierda"
).split()
#: Phrases of two words, one voter each.
PHRASES = ("shut up", "hate you", "kill yourself", "screw you", "you idiot", "you people", "go die", "ta gueule", "halt's maul")
#: Voters on typing: at least this share of letters in capitals, so many exclamation marks in a row, and hits of the lexicon.
CAPITALS, EXCLAMATIONS, HITS = 0.5, 3, 2
PATTERNS = ("capitals", "exclamations", "repeated insult")
#: Words and stems learned from labels that vote: so many, each where it makes up at least this share of a text's words.
LEARNED, LEARNED_SHARE = 24, 0.02
N_VOTERS = len(LEXICON) + len(PHRASES) + len(PATTERNS) + LEARNED + 1

#: Labelled rows in the fit, and word features.
MAX_FIT, FEATURES = 12_000, 256
#: A word's first bytes, so many, are features too.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
HELD_OUT = 2

_PLAIN = np.array([i | 32 if chr(i).isascii() and chr(i).isalpha() else 32 if i < 128 and i != 39 else i for i in range(256)], np.uint8)


def words_in(data: np.ndarray, at: np.ndarray, stems: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every word, in order, of texts given end to end; with ``stems``, those of all words follow."""
    plain = _PLAIN[data]
    solid = plain != 32
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.array([], np.uint64), np.array([], np.int64)
    place = np.arange(starts[0], len(plain)) - np.repeat(starts, np.diff(np.append(starts, len(plain))))
    terms = _BYTE[plain[starts[0] :]] * (_IN_WORD[place & 255] + (place >> 8).astype(np.uint64))
    begins = starts - starts[0]
    row = np.searchsorted(at, starts, side="right") - 1
    hashes = mixed(np.add.reduceat(terms, begins))
    if not stems:
        return hashes, row
    letters = np.add.reduceat(solid[starts[0] :].astype(np.int32), begins)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
    every, rows = [hashes], [row]
    for k in STEMS:
        long = np.flatnonzero(letters > k)
        every.append(mixed(sums[begins[long] + k] - sums[begins[long]] + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(every), np.concatenate(rows)


def word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return words_in(data, np.array([0, len(data)]))[0][0]


def phrase_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first + mixed(second))


_LEXICON = np.array([word_hash(w) for w in LEXICON], np.uint64)
_PHRASES = np.array([phrase_hash(*(np.array([word_hash(w)]) for w in p.split()))[0] for p in PHRASES], np.uint64)


def places_in(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index into hashes, index into table)`` of what ``table`` holds. A bit for each value of 16 bits sorts out most first."""
    if not len(table) or not len(hashes):
        return np.array([], np.int64), np.array([], np.int64)
    flags = np.zeros(1 << 16, bool)
    flags[(table >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(flags[(hashes >> np.uint64(48)).astype(np.int64)])
    order = np.argsort(table)
    where = np.minimum(np.searchsorted(table[order], hashes[at]), len(table) - 1)
    hit = table[order][where] == hashes[at]
    return at[hit], order[where[hit]]


def voted(data: np.ndarray, at: np.ndarray, learned: np.ndarray, tokens: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which voters fire, as a matrix of rows and ``N_VOTERS`` columns of 0 and 1; the last votes clean."""
    hashes, row = every, rows = tokens or words_in(data, at, stems=True)
    n = len(at) - 1
    out = np.zeros((n, N_VOTERS), np.float64)
    i, j = places_in(every, _LEXICON)
    np.add.at(out, (rows[i], j), 1)
    hits = out.sum(1)
    if len(hashes) > 1:
        i, j = places_in(phrase_hash(hashes[:-1], hashes[1:]), _PHRASES)
        same = row[i] == row[i + 1]
        out[row[i[same]], len(LEXICON) + j[same]] = 1
    first = len(LEXICON) + len(PHRASES)
    capital = (data >= 65) & (data <= 90)
    letter = capital | ((data >= 97) & (data <= 122))
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    out[:, first] = sums(capital) >= CAPITALS * np.maximum(sums(letter), 20)
    run = data == 33
    for _ in range(EXCLAMATIONS - 1):
        run = np.append(run[1:], False) & (data == 33)
    out[:, first + 1] = sums(run) > 0
    out[:, first + 2] = hits >= HITS
    i, j = places_in(every, learned)
    share = np.zeros((n, LEARNED))
    np.add.at(share, (rows[i], j), 1)
    out[:, first + 3 : -1] = share >= np.maximum(LEARNED_SHARE * np.bincount(rows, minlength=n)[:, None] / (1 + len(STEMS) / 2), 1)
    out = np.minimum(out, 1)
    out[:, -1] = out[:, :first].sum(1) + out[:, first + 2 : -1].sum(1) == 0
    return out


@dataclass
class LabelModel:
    """Voters' rates of firing on toxic and clean documents, their correlations given the label, and what each weighs."""

    balance: float
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of toxic against clean; a voter that abstains says nothing."""
        return np.log(self.balance / (1 - self.balance)) + votes @ (np.log(self.fires_toxic / self.fires_clean) * self.weight)


def label_model(n: float, joint: np.ndarray, balance: float) -> LabelModel:
    """From the number of documents and how often each two voters fire together (the diagonal: how often each fires)."""
    m = len(joint)
    rate = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(rate, rate)
    v = balance * (1 - balance)
    live = np.flatnonzero((rate * n >= 5) & (rate < 0.999))
    trusted = np.ones((m, m), bool)
    d = np.zeros(m)
    for _ in range(3):  # each round leaves out the pairs found correlated
        for i in live:
            found = []
            for a, j in enumerate(live):
                for k in live[a + 1 :]:
                    if i not in (j, k) and trusted[i, j] and trusted[i, k] and trusted[j, k] and abs(cov[j, k]) > 1e-9:
                        found.append(cov[i, j] * cov[i, k] / cov[j, k])
            square = np.median(found) if found else 0.0
            d[i] = np.sqrt(max(square, 0.0) / v) * (-1 if i == m - 1 else 1)
        noise = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        rest = (cov - np.outer(d, d) * v) / np.outer(noise, noise)
        np.fill_diagonal(rest, 0)
        trusted = np.abs(rest) < 0.15
    toxic = np.clip(rate + d * (1 - balance), 1e-4, 1 - 1e-4)
    clean = np.clip(rate - d * balance, 1e-4, 1 - 1e-4)
    silent = np.ones(m, bool)
    silent[live] = False
    # What hardly ever fires can't be estimated and is taken at a fixed rate.
    toxic[silent], clean[silent] = 2e-3, 1e-4
    correlation = np.where(trusted, 0, np.clip(rest, 0, 1))
    return LabelModel(balance, toxic, clean, correlation, 1 / (1 + correlation.sum(1)))


def joint_votes(texts: DataFrame, learned: np.ndarray) -> tuple[float, np.ndarray]:
    """The number of documents with words, and how often every two voters fire together, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((N_VOTERS, N_VOTERS)), 0
        for batch in batches:
            for part in slices(batch, "text"):
                votes = voted(*raw_texts(part.column("text")), learned)
                total += votes.T @ votes
                n += part.num_rows
        flat = np.append(total.ravel(), n).astype(np.int64)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    flat = np.zeros(N_VOTERS**2 + 1)
    for at, n in texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():  # at most voters squared rows
        flat[at] = n
    return float(flat[-1]), flat[:-1].reshape(N_VOTERS, N_VOTERS)


def training_rows(texts: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, label`` of at most ``most`` labelled rows that aren't held out, by smallest hash of doc_id, then of the text; equal ones once."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("double").alias("toxic")).filter("id is not null and toxic is not null")
    some = F.broadcast(ids.filter(~held_out(F.col("id"))).groupBy("id").agg(F.avg("toxic").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most))
    versions = texts.select("doc_id", "text", F.xxhash64("text").alias("version"))
    chosen = versions.join(some, versions.doc_id == some.id).select("id", "version", "label").distinct().orderBy(F.xxhash64("id"), "id", "version").limit(most)
    chosen = F.broadcast(staged(chosen, "chosen"))
    rows = versions.join(chosen, (versions.doc_id == chosen.id) & (versions.version == chosen.version)).groupBy("id", chosen.version).agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return staged(rows.select("text", "label"), "labelled")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def word_shares(rows: DataFrame, most: int) -> list[tuple[int, float, float]]:
    """``(word, toxic, clean)``: the ``most`` words and stems that differ most between toxic and clean rows, with how many rows have them."""
    size = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("label") > 0.5).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, row = words_in(*raw_texts(part.column("text")), stems=True)
                order = np.lexsort((row, hashes))
                hashes, row = hashes[order], row[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                toxic = part.column("label").to_numpy()[row[fresh]] > 0.5
                words, which = np.unique(hashes[fresh], return_inverse=True)
                n = [np.bincount(which[x], minlength=len(words)).astype(np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *map(pa.array, n)], names=["word", "toxic", "clean"])

    counts = rows.select("text", "label").mapInArrow(run, "word bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    expected = (F.col("toxic") + F.col("clean")) * (size[True] / (size[True] + size[False]))
    deviations = F.abs((F.col("toxic") - expected) / F.sqrt(expected + 1))  # about
    best = counts.filter("toxic > 2").orderBy(F.desc(deviations), "word").limit(most)
    return [(r["word"], float(r["toxic"]), float(r["clean"])) for r in best.collect()]


def features(data: np.ndarray, at: np.ndarray, learned: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Damped counts of the chosen words and stems, and of all words, then the voters."""
    tokens = words_in(data, at, stems=True)
    counts = np.zeros((len(at) - 1, len(words) + 1))
    i, j = places_in(tokens[0], words)
    np.add.at(counts, (tokens[1][i], j), 1)
    counts[:, -1] = np.bincount(tokens[1], minlength=len(at) - 1)
    return np.concatenate((np.log2(1 + counts), voted(data, at, learned, tokens)), axis=1)


def fitted(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method: weights and intercept."""
    full = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(penalty), full.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Scorer:
    learned: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    intercept: float


#: A clean document is labelled toxic no more often than this.
MOST_WRONG = 0.02


def given_label_odds(label: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log-odds with the given labels as one more voter, whose error rates are estimated from the posteriors in turn."""
    out = odds + np.where(label > 0.5, 2.0, -2.0)
    for _ in range(10):
        q = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        yes = np.clip((q * label).sum() / max(q.sum(), 1e-9), 0.01, 0.99)
        wrong = np.clip(((1 - q) * label).sum() / max((1 - q).sum(), 1e-9), 0.001, MOST_WRONG)
        out = odds + label * np.log(yes / wrong) + (1 - label) * np.log((1 - yes) / (1 - wrong))
    return out


def train(texts: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> tuple[Scorer, LabelModel]:
    rows = training_rows(texts, labels, most)
    told = word_shares(rows, FEATURES)
    words = np.array([w for w, _, _ in told], np.int64).view(np.uint64)
    # Stems of one word have the same counts: one of them votes, and none for a word of the lexicon.
    lexicon = set(_LEXICON.view(np.int64).tolist())
    known = {(t, c) for w, t, c in told if w in lexicon}
    fresh = {(t, c): w for w, t, c in reversed(told) if t > c and (t, c) not in known}
    learned = np.array(list(reversed(fresh.values()))[:LEARNED], np.int64).view(np.uint64)
    balance = float(np.clip(rows.agg(F.avg("label")).first()[0] or 0.05, 0.01, 0.5))
    model = label_model(*joint_votes(texts, learned), balance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*raw_texts(part.column("text")), learned, words).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "x"])

    sample = rows.mapInArrow(run, "label double, x array<float>").orderBy("label", "x").toPandas()  # at most ``most`` rows
    if not len(sample):
        weights = np.append(0, np.log(model.fires_toxic / model.fires_clean) * model.weight)
        return Scorer(learned, words[:0], weights, float(np.log(balance / (1 - balance)))), model
    x = np.stack(sample["x"].to_numpy()).astype(np.float64)
    odds = given_label_odds(sample["label"].to_numpy(), model.log_odds(x[:, len(words) + 1 :]))
    weights, intercept = fitted(x, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return Scorer(learned, words, weights, intercept), model


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = sent(docs.sparkSession.sparkContext, train(texts, labels, most)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = received(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*raw_texts(part.column("text")), s.learned, s.words)
                p = 1 / (1 + np.exp(-np.clip(x @ s.weights + s.intercept, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
