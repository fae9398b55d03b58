"""Problem 10: subject areas of each document.

A document is read sentence by sentence.  A sentence is the mean of its word vectors, a word the mean of its own and its
subword embeddings, and independent logistic outputs give a probability per subject.  The model learns from whole-document
labels: every sentence of a labelled document is trained towards the document's subjects, so that general sentences, which
occur under all labels, end near the base rate and sentences of a subject near one.  A document has a subject if at least
``MIN_SENTENCES`` sentences do; passing remarks and general talk stay below that.

Training is synchronous: each round, every partition of the labelled sample computes its gradient under the shared
weights, the gradients are added, and one Adam step is taken.  The sample is bounded by ``SAMPLE_DOCS`` documents, so the
model, its gradients and the rounds do not grow with the corpus; scoring reads every document whole.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cluster import cut

SAMPLE_DOCS = 6000  # labelled documents used for training and for choosing the threshold
BUCKETS, WIDTH, SEED = 1 << 15, 16, 7
ROUNDS, RATE, PARTS = 22, 0.25, 6
HELD_OUT = 5  # every fifth labelled document chooses the threshold
MIN_SENTENCES = 4
KEPT_WORDS = 200_000  # of a cache
MOST_SUBJECTS = 1000  # of the stated list
SENTENCE_WORDS = 400  # a longer run without an end mark is cut into sentences of this many words

END = re.compile(r"(?<=[.!?])[\"'*_)\]]*\s+(?!\d)|(?<=[。！？])|\n\s*\n|\r\n\s*\r\n")
WORD = re.compile(r"[^\W\d_]+")
HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]+")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, lower-cased; runs of Chinese, Japanese or Korean characters become overlapping pairs."""
    out = []
    for part in END.split(text or ""):
        words = WORD.findall(part.lower())
        if not part.isascii() and HAN.search(part):
            found, words = words, []
            for w in found:
                if not HAN.search(w):
                    words.append(w)
                    continue
                for run in HAN.findall(w):
                    words += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
        for lo in range(0, len(words), SENTENCE_WORDS):
            out.append(words[lo : lo + SENTENCE_WORDS])
    return out


def pieces(word: str) -> list[int]:
    """Embedding rows of a word: its own and those of its character 3- to 5-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


_pieces: dict[str, list[int]] = {}


def known_pieces(word: str) -> list[int]:
    """``pieces``, kept for the ``KEPT_WORDS`` words that a worker process met last, since words recur from batch to batch."""
    got = _pieces.get(word)
    if got is None:
        if len(_pieces) >= KEPT_WORDS:
            _pieces.clear()
        got = _pieces[word] = pieces(word)
    return got


class Bag:
    """Sentences as index arrays: words of each sentence, pieces of each distinct word."""

    def __init__(self, docs: list[list[list[str]]], ids: dict[str, int] | None = None):
        vocab: dict[str, int] = {}
        word, length, owner = [], [], []
        for d, sents in enumerate(docs):
            for s in sents:
                if s:
                    word += [vocab.setdefault(w, len(vocab)) for w in s]
                    length.append(len(s))
                    owner.append(d)
        self.word, self.length, self.owner = np.array(word, np.int64), np.array(length, np.int64), np.array(owner, np.int64)
        rows = [known_pieces(w) for w in vocab]
        self.piece = np.array([p for r in rows for p in r], np.int64)
        self.pieces = np.array([len(r) for r in rows], np.int64)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        if not len(self.length):
            return np.zeros((0, table.shape[1]), np.float32)
        of_word = np.add.reduceat(table[self.piece], starts(self.pieces)) / self.pieces[:, None].astype(np.float32)
        return np.add.reduceat(of_word[self.word], starts(self.length)) / self.length[:, None].astype(np.float32)

    def back(self, grad: np.ndarray, rows: int) -> np.ndarray:
        """Gradient of the embedding table from that of the sentence vectors."""
        g = np.repeat(grad / self.length[:, None], self.length, axis=0)
        of_word = scatter(self.word, g, len(self.pieces)) / self.pieces[:, None]
        return scatter(self.piece, np.repeat(of_word, self.pieces, axis=0), rows)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], rows) for j in range(values.shape[1])], axis=1).astype(np.float32)


def fresh(outputs: int, seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "table": (r.random((BUCKETS, WIDTH), np.float32) - 0.5) * (2 / WIDTH),
        "out": ((r.random((WIDTH, outputs), np.float32)) - 0.5).astype(np.float32),
        "bias": np.full(outputs, -2.0, np.float32),
    }


def scores(model: dict[str, np.ndarray], bag: Bag) -> np.ndarray:
    z = bag.vectors(model["table"]) @ model["out"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(model: dict[str, np.ndarray], bag: Bag, labels: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Summed gradient of the logistic losses over the sentences of the training documents, and their number."""
    v = bag.vectors(model["table"])
    p = 1 / (1 + np.exp(-np.clip(v @ model["out"] + model["bias"], -30, 30)))
    target = labels[bag.owner]
    d = (p - target).astype(np.float32)
    return {"table": bag.back(d @ model["out"].T, BUCKETS), "out": v.T @ d, "bias": d.sum(0)}, len(d)


class Adam:
    def __init__(self, model: dict[str, np.ndarray], rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.t += 1
        rate = self.rate * max(0.1, 1 - max(0, self.t - ROUNDS // 2) / (ROUNDS // 2))
        for k, x in self.model.items():
            g = grads[k] / max(n, 1) * 100
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.98 * self.v[k] + 0.02 * g * g
            x -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.98**self.t)) + 1e-6)


def counts_at(p: np.ndarray, owner: np.ndarray, docs: int, cut_at: float) -> np.ndarray:
    return np.stack([np.bincount(owner, p[:, s] >= cut_at, docs) for s in range(p.shape[1])], axis=1)


def _pack(subjects: list[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.array([[s in set(have) for s in subjects] for have in pdf["subjects"]], np.float32).reshape(len(pdf), len(subjects))
        sents, held = [sentences(t) for t in pdf["text"]], pdf["held"].to_numpy(bool)
        bags = [(Bag([s for s, h in zip(sents, held) if h == side]), y[held == side]) for side in (False, True)]
        return pd.DataFrame({"part": [key[0]], "blob": [pickle.dumps(bags)]})

    return run


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, np.ndarray], float]:
    """The model and its sentence threshold, from at most ``SAMPLE_DOCS`` labelled documents, picked by hash.

    Labels of unknown documents and unknown subjects are left out; without any label the fresh model sees no subject.
    """
    spark = docs.sparkSession
    named = labels.where(F.col("subject").isin(subjects)).groupBy(F.col(id_col).alias("id")).agg(F.collect_set("subject").alias("subjects"))
    pick = named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    place = F.xxhash64(F.lit(SEED), F.col("id"))
    sample = texts.join(pick, "id").select("text", "subjects", F.pmod(place, F.lit(PARTS)).alias("part"), (F.pmod(F.shiftright(place, 8), F.lit(HELD_OUT)) == 0).alias("held"))
    packed = cut(sample.groupBy("part").applyInPandas(_pack(subjects), "part long, blob binary"))
    model = fresh(len(subjects))
    opt = Adam(model, RATE)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def grads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for blob in pdf["blob"]:
                    (bag, y), _ = pickle.loads(blob)
                    if len(bag.length):
                        g, n = gradient(shared.value, bag, y)
                        rows = np.nonzero(np.abs(g["table"]).sum(1))[0]
                        yield pd.DataFrame({"g": [pickle.dumps((rows, g["table"][rows], g["out"], g["bias"]))], "n": [n]})

        total, n = {k: np.zeros_like(v) for k, v in model.items()}, 0
        for r in packed.mapInPandas(grads, "g binary, n long").collect():  # PARTS rows, each no larger than the model
            rows, table, out, bias = pickle.loads(bytes(r["g"]))
            total["table"][rows] += table
            total["out"] += out
            total["bias"] += bias
            n += r["n"]
        shared.destroy()
        if n:
            opt.step(total, n)
    shared = spark.sparkContext.broadcast(model)
    cuts = [round(float(c), 2) for c in np.arange(0.2, 0.85, 0.05)]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["blob"]:
                _, (bag, y) = pickle.loads(blob)
                p = scores(shared.value, bag)
                for c in cuts:
                    said = counts_at(p, bag.owner, len(y), c) >= MIN_SENTENCES
                    yield pd.DataFrame({"c": [c], "hit": [int((said & (y > 0)).sum())], "said": [int(said.sum())], "true": [int(y.sum())]})

    rows = packed.mapInPandas(judge, "c double, hit long, said long, true long").groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("true").alias("true")).collect()
    found = sorted((round(2 * r["hit"] / max(1, r["said"] + r["true"]), 6), r["c"]) for r in rows)
    best = [c for f, c in found if f == found[-1][0]] if found else [0.5]
    return model, sorted(best)[len(best) // 2]


def score(docs: DataFrame, model: dict[str, np.ndarray], subjects: list[str], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, subject, sentences, strength) for every subject that at least one sentence of a document shows.

    Whole texts are read; null and empty texts show nothing; the model is broadcast, its size is fixed by parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                bag = Bag([sentences(t) for t in part["text"]])
                p = scores(shared.value, bag)
                n, top = counts_at(p, bag.owner, len(part), threshold), np.zeros((len(part), len(subjects)))
                np.maximum.at(top, bag.owner, p)
                d, s = np.nonzero(n)
                yield pd.DataFrame({"doc_id": part["id"].to_numpy()[d], "subject": np.array(subjects, object)[s], "sentences": n[d, s], "strength": top[d, s]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").mapInPandas(run, "doc_id long, subject string, sentences long, strength double")


def subjects_of(docs: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """(doc_id, subject, sentences, strength): the subjects to which a document gives at least ``MIN_SENTENCES`` sentences."""
    names = sorted(r[0] for r in subject_list.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    model, threshold = train(docs, labels, names)
    return score(docs, model, names, threshold).where(F.col("sentences") >= MIN_SENTENCES)
