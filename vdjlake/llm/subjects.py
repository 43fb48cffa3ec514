"""Subject areas of documents by seeded non-negative factorisation.

The document-term matrix X (words and pairs of neighbouring words) is factored into
W (documents x components) and H (components x terms) by alternating multiplicative
updates for the Kullback-Leibler divergence. The first components are anchored, one
for each subject; the last is a background. Anchors are seeded with the terms that
documents labelled with a subject use more than the rest. From then on all documents
decide: given H, the rows of W are updated until they settle; a term is an anchor of
the subject that the documents using it are mostly about, by their rows of W, if that
subject holds at least ``OWN`` of its use, and the background explains the rest of its
use; all other terms belong to the background. W and H alternate until the anchors
settle. A row of W is thus the document's subject mixture.

An anchored term has two components only, its subject and the background, so an
update costs one number per cell of the matrix and not one per component.

A sentence gets its row of the factorisation under its document's mixture: what its
terms send to each subject, weighed by the subject's part in the document, so a
mention of another subject weighs little. It is on the subject with the largest value,
or on none if its subjects together explain less than ``SURE`` of one term. A document
is about a subject when at least ``least_share`` of its sentences on any subject are:
greetings, thanks, footers and raw sequences are on none and count for none.

Each text is read once, in batches of bytes; all later passes work on numbered terms.
What reaches the driver is the vocabulary - terms of at least ``LEAST_DOCS`` documents
and ``LEAST_PART`` of all - with one number per subject, whatever the corpus. Seeds
come from at most ``LABELLED`` labelled documents; everything else from all documents.

Defined cases: null, empty and wordless texts, and texts without a sentence on
any subject have no row; raw sequences are no words; mark-up, letter case, odd
blanks, decomposed accents and doubly encoded ones are evened out; letters of scripts
without blanks are words of their own; a text of any length is read whole; repeated
documents get equal subjects; labels of unknown documents or subjects are left out;
without any label no document has a subject.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import discard, table

#: A term of the vocabulary is in so many documents, and in such a part of all documents, at least.
LEAST_DOCS, LEAST_PART = 3, 1e-5
#: Labelled documents, chosen by hash, from which anchors are seeded.
LABELLED = 200_000
#: Part of a term's use that its subject must hold; of a seed, when all subjects' labelled documents count alike.
OWN = 0.5
#: Added to a subject's part of the document before it weighs a sentence's terms.
PRIOR = 0.05
#: Terms that a sentence's subjects must explain together.
SURE = 0.5
#: W has settled when less of it changes, H when less of its anchors do; the most updates of either.
SETTLED, MOST_UPDATES = 1e-3, 100
#: Documents of one numeric step.
STEP = 250


# ---- reading


_INVISIBLE = re.compile("[​‌‍­⁠﻿]")
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_TWICE = re.compile("[ÂÃ][\u0080-¿]")


def plain(text: str | None) -> str:
    """Without mark-up, invisible characters and variants of one spelling."""
    if not text:
        return ""
    t = text
    if not t.isascii():
        if "Ã" in t or "Â" in t:  # UTF-8 read as a one-byte encoding
            try:
                t = t.encode("cp1252").decode("utf-8")
            except UnicodeError:
                t = _TWICE.sub(lambda m: m[0].encode("latin-1").decode("utf-8"), t)
        t = _INVISIBLE.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub("\n", t)
    return t.replace("\0", " ")


def _set(values) -> np.ndarray:
    a = np.zeros(256, dtype=bool)
    a[list(values)] = True
    return a


_LETTER = _set([*range(65, 91), *range(97, 123), *range(128, 256)])
_BLANK, _LINE, _STOP, _CLOSE = _set(b" \t\n\r\x0b\x0c"), _set(b"\n\r\0"), _set(b".!?"), _set(b"'\")]")
_BASES, _RESIDUES = _set(b"ACGTUN"), _set(b"ACDEFGHIKLMNPQRSTVWY*")
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence, text) of every word of the texts; sentences are numbered through, texts from 0.

    A sentence ends at a stop before a blank, at a line's end, at two blanks or a dash between blanks.
    """
    b = np.frombuffer("\0".join(map(plain, texts)).encode("utf-8", "replace") + b"\0", np.uint8)
    none = np.zeros(0, dtype=np.int64)
    letter = _LETTER[b]
    for lead, more in ((0xC2, 1), (0xE2, 2)):  # signs of Latin-1, punctuation
        at = np.flatnonzero(b == lead)
        for o in range(more + 1):
            letter[at + o] = False
    escaped = (b[:-1] == 92) & ((b[1:] == 110) | (b[1:] == 114))  # \n and \r as two letters
    letter[1:][escaped] = False
    begins = letter & ~np.concatenate([[False], letter[:-1]])
    begins |= letter & (b >= 0xE3) & (b <= 0xED)  # scripts without blanks: each letter
    start = np.flatnonzero(begins)
    if not len(start):
        return none.astype(np.uint64), none, none
    at = np.flatnonzero(letter)
    first = np.searchsorted(at, start)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    low = b.copy()
    low[(b >= 65) & (b <= 90)] += 32
    upper = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
    low[upper] += 32
    h = _mixed(np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * _POWER[place & 0xFFFF], first))
    raw = np.zeros(len(start), dtype=bool)
    for i in np.flatnonzero(size >= 12):
        w = b[start[i] : start[i] + size[i]]
        raw[i] = _BASES[w].all() or (size[i] >= 16 and _RESIDUES[w].all())
    blank, after = _BLANK[b], _STOP[b]
    for _ in range(2):  # closing marks after a stop
        after[1:] |= _CLOSE[b[1:]] & after[:-1]
    cut = _LINE[b]
    cut[1:] |= blank[1:] & (after[:-1] | blank[:-1])
    cut[:-1] |= escaped
    cut[1:-1] |= (b[1:-1] == 45) & blank[:-2] & blank[2:]
    keep = ~raw
    return h[keep], np.cumsum(cut)[start][keep], np.cumsum(b == 0)[start][keep]


def _terms(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, sentence) of words given by sentence sizes: the words, then the pairs of neighbours."""
    sentence = np.repeat(np.arange(len(size)), size)
    near = np.flatnonzero(sentence[1:] == sentence[:-1])
    pair = _mixed(h[near] * np.uint64(3) + h[near + 1])
    return np.concatenate([h, pair]), np.concatenate([sentence, sentence[near]])


_READ = pa.schema([("k", pa.int64()), ("labels", pa.list_(pa.int32())), ("words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), type=pa.int32()), pa.array(values, type=kind))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, labels, text) to the words of each text and the number of words of each of its sentences."""
    for b in batches:
        for lo in range(0, b.num_rows, STEP):
            part = b.slice(lo, STEP)
            h, sentence, text = words(part.column(2).to_pylist())
            starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(starts, len(h)))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(h.view(np.int64), np.bincount(text, minlength=n), pa.int64()), _lists(size, np.bincount(text[starts], minlength=n), pa.int32())], schema=_READ)


def _flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, size of each list)."""
    return c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy())


def _cells(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, sentence, row of each sentence, words of each sentence) of read texts (.., words, sizes)."""
    h, _ = _flat(part.column(part.num_columns - 2))
    size, sentences = _flat(part.column(part.num_columns - 1))
    term, sentence = _terms(h.view(np.uint64), size)
    return term, sentence, np.repeat(np.arange(part.num_rows), sentences), size


# ---- the vocabulary and its seeds


_USE = pa.schema([("t", pa.int64()), ("s", pa.int32()), ("docs", pa.int64()), ("uses", pa.float64()), ("logs", pa.float64())])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and uses of each term: over all documents (subject -1), and over those labelled with each subject."""
    for b in batches:
        for lo in range(0, b.num_rows, 8 * STEP):
            part = b.slice(lo, 8 * STEP)
            term, sentence, row, _ = _cells(part)
            if not len(term):
                continue
            t, number = np.unique(term, return_inverse=True)
            cell, count = np.unique(number * part.num_rows + row[sentence], return_counts=True)
            at, doc = cell // part.num_rows, cell % part.num_rows
            label, many = _flat(part.column(1))
            labelled = np.repeat(np.arange(part.num_rows), many)
            for s in (-1, *np.unique(label).tolist()):
                take = np.ones(len(cell), dtype=bool) if s < 0 else np.isin(doc, labelled[label == s])
                docs = np.bincount(at[take], minlength=len(t))
                some = np.flatnonzero(docs)
                add = lambda w: np.bincount(at[take], weights=w[take], minlength=len(t))[some]
                yield pa.RecordBatch.from_arrays([pa.array(t[some].view(np.int64)), pa.array(np.full(len(some), s, dtype=np.int32)), pa.array(docs[some], type=pa.int64()), pa.array(add(count.astype(float))), pa.array(add(np.log1p(count)))], schema=_USE)


def vocabulary(read: DataFrame, n_subjects: int, n_docs: int) -> pd.DataFrame:
    """Terms in order (t), with documents, uses and, for each subject k, documents (d{k}) and logarithmic uses (x{k}) among the labelled."""
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("s") == s, F.col(c))), F.lit(0))
    use = read.select("k", "labels", "words", "sizes").mapInArrow(_uses, "t long, s int, docs long, uses double, logs double")
    per = use.groupBy("t").agg(of(-1, "docs").alias("docs"), of(-1, "uses").alias("uses"), of(-1, "logs").alias("logs"), *[of(k, "docs").alias(f"d{k}") for k in range(n_subjects)], *[of(k, "logs").alias(f"x{k}") for k in range(n_subjects)])
    v = per.where(F.col("docs") >= max(LEAST_DOCS, LEAST_PART * n_docs)).toPandas()
    return v.iloc[np.argsort(v["t"].to_numpy().view(np.uint64), kind="stable")].reset_index(drop=True)


def seeds(v: pd.DataFrame, n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each term or -1, its weight): terms that labelled documents of a subject use more than those of the others do."""
    if not len(v):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    x = v[[f"x{k}" for k in range(n_subjects)]].to_numpy(float).T
    docs = v[[f"d{k}" for k in range(n_subjects)]].to_numpy(float).T
    back = v["logs"].to_numpy(float)
    size = x.sum(axis=1, keepdims=True)
    p = (x + 0.01 * back / back.sum() * size) / np.maximum(1.01 * size, 1e-12)
    best = p.argmax(axis=0)
    claimed = (p.max(axis=0) >= OWN * p.sum(axis=0)) & (docs.max(axis=0) >= 2)
    return np.where(claimed, best, -1), np.where(claimed, x[best, np.arange(len(v))], 0.0)


# ---- the factorisation


class Parts:
    """H: for each term its anchor (-1: none), and its shares in the anchor's component and in the background."""

    def __init__(self, anchor: np.ndarray, held: np.ndarray, uses: np.ndarray, n_subjects: int, hard: bool = False):
        self.k, self.anchor = n_subjects, anchor
        size = np.bincount(anchor[anchor >= 0], weights=held[anchor >= 0], minlength=n_subjects)
        rest = np.where(anchor >= 0, 0.0 if hard else np.maximum(uses - held, 0), uses)
        self.own = np.where(anchor >= 0, held / np.maximum(size[anchor], 1e-12), 0.0)
        self.back = rest / max(rest.sum(), 1e-12)

    def mixtures(self, row: np.ndarray, n: int, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(W of n rows; what the cells send to their anchors): multiplicative updates of W until it settles."""
        k, a = self.k, self.anchor[term]
        at = np.flatnonzero(a >= 0)
        total = np.bincount(row, weights=count, minlength=n)
        r, c, slot = row[at], count[at], row[at] * k + a[at]
        own, back = self.own[term[at]], self.back[term[at]]
        w, b = np.ones(n * k), np.ones(n)
        sent = np.zeros(len(at))
        for _ in range(MOST_UPDATES):
            mine = w[slot] * own
            sent = c * mine / np.maximum(mine + b[r] * back, 1e-300)
            new = np.bincount(slot, weights=sent, minlength=n * k)
            left = total - np.bincount(r, weights=sent, minlength=n)
            change = np.abs(new - w).sum() + np.abs(left - b).sum()
            w, b = new, left
            if change <= SETTLED * total.sum():
                break
        out = np.zeros(len(term))
        out[at] = sent
        return np.concatenate([w.reshape(n, k), b[:, None]], axis=1), out


def _shares(w: np.ndarray) -> np.ndarray:
    """Each row's parts of the subjects, without the background."""
    s = w[:, :-1]
    return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-12)


_NUMBERED = pa.schema([("k", pa.int64()), ("term", pa.list_(pa.int32())), ("count", pa.list_(pa.float32())), ("at", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


def _number(vocabulary):
    """Texts as numbers of the vocabulary: the document's terms with counts, and the terms of its sentences with their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                n = part.num_rows
                term, sentence, row, size = _cells(part)
                number = np.minimum(np.searchsorted(known, term), len(known) - 1)
                ok = known[number] == term
                number, sentence = number[ok], sentence[ok]
                order = np.argsort(sentence.astype(np.int32), kind="stable")
                number, sentence = number[order], sentence[order]
                cell, count = np.unique(row[sentence] * len(known) + number, return_counts=True)
                sizes = np.bincount(sentence, minlength=len(size))
                some = np.flatnonzero(sizes)
                doc = row[some]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(cell % len(known), np.bincount(cell // len(known), minlength=n), pa.int32()), _lists(count.astype(np.float32), np.bincount(cell // len(known), minlength=n), pa.float32()), _lists(number, np.bincount(row[sentence], minlength=n), pa.int32()), _lists(sizes[some], np.bincount(doc, minlength=n), pa.int32())],
                    schema=_NUMBERED,
                )

    return run


def _rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    term, n = _flat(part.column(part.schema.get_field_index("term")))
    count, _ = _flat(part.column(part.schema.get_field_index("count")))
    return np.repeat(np.arange(part.num_rows), n), term, count.astype(float)


def _held(parts, n_terms: int):
    """Adds up, per term and subject, the use by documents in proportion to their mixtures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = parts.value
        total = np.zeros((h.k, n_terms))
        for b in batches:
            for lo in range(0, b.num_rows, 4 * STEP):
                part = b.slice(lo, 4 * STEP)
                row, term, count = _rows(part)
                mix = _shares(h.mixtures(row, part.num_rows, term, count)[0])
                for k in range(h.k):
                    m = mix[row, k]
                    at = np.flatnonzero(m)
                    total[k] += np.bincount(term[at], weights=count[at] * m[at], minlength=n_terms)
        used = np.flatnonzero(total.sum(axis=0))
        for lo in range(0, len(used), 20_000):
            u = used[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(u, type=pa.int32())] + [pa.array(total[k, u]) for k in range(h.k)], names=["t"] + [f"c{k}" for k in range(h.k)])

    return run


def factor(numbered: DataFrame, v: pd.DataFrame, n_subjects: int) -> Parts:
    """H after alternating updates over all documents, until its anchors settle."""
    sc = numbered.sparkSession.sparkContext
    uses = v["uses"].to_numpy(float)
    anchor, held = seeds(v, n_subjects)
    h = Parts(anchor, held, uses, n_subjects, hard=True)
    for _ in range(MOST_UPDATES):
        if not (h.anchor >= 0).any():
            return h
        shared = sc.broadcast(h)
        parts = numbered.select("term", "count").mapInArrow(_held(shared, len(v)), "t int, " + ", ".join(f"c{k} double" for k in range(n_subjects)))
        sums = parts.groupBy("t").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_subjects)]).toPandas()
        shared.destroy()
        n = np.zeros((n_subjects, len(v)))
        n[:, sums["t"].to_numpy()] = sums[[f"c{k}" for k in range(n_subjects)]].to_numpy(float).T
        all_, best = n.sum(axis=0), n.argmax(axis=0)
        most = n.max(axis=0)
        anchor = np.where((all_ > 0) & (most >= OWN * all_), best, -1)
        settled = (anchor != h.anchor).mean() <= SETTLED
        h = Parts(anchor, most, uses, n_subjects)
        if settled:
            break
    return h


_SHARE = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("n", pa.int32()), ("share", pa.float64()), ("weight", pa.float64())])


def _assign(parts, subjects: list[str]):
    """Sentences of each document on each subject, their share, and the subject's part of W."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = parts.value
        for b in batches:
            for lo in range(0, b.num_rows, 4 * STEP):
                part = b.slice(lo, 4 * STEP)
                row, term, count = _rows(part)
                w, _ = h.mixtures(row, part.num_rows, term, count)
                mix = _shares(w)
                at, _ = _flat(part.column(part.schema.get_field_index("at")))
                size, n = _flat(part.column(part.schema.get_field_index("sizes")))
                of, s = np.repeat(np.arange(part.num_rows), n), np.repeat(np.arange(len(size)), size)
                mine = np.flatnonzero(h.anchor[at] >= 0)
                a, t, d = h.anchor[at[mine]], at[mine], of[s[mine]]
                sent = w[d, a] * h.own[t]
                sent = sent / np.maximum(sent + w[d, -1] * h.back[t], 1e-300)
                mass = np.bincount(s[mine] * h.k + a, weights=sent, minlength=len(size) * h.k).reshape(-1, h.k)
                about = mass.sum(axis=1) >= SURE
                top = (mass * (mix[of] + PRIOR)).argmax(axis=1)
                n = np.bincount(of[about] * h.k + top[about], minlength=part.num_rows * h.k).reshape(-1, h.k)
                i, k = np.nonzero(n)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array([subjects[x] for x in k], type=pa.string()), pa.array(n[i, k], type=pa.int32()), pa.array(n[i, k] / n[i].sum(axis=1)), pa.array(mix[i, k])], schema=_SHARE)

    return run


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """``doc_id, subject, n, share, weight``: sentences on a subject, their share of those on any subject, and its part of W."""
    sc = docs.sparkSession.sparkContext
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))]) if subjects else F.lit(None).cast("map<string,int>")
    marked = labels.select(F.col("doc_id").cast("long").alias("k"), F.try_element_at(number, F.col("subject")).alias("s")).where("k is not null and s is not null")
    marked = marked.groupBy("k").agg(F.collect_set("s").alias("labels")).orderBy(F.xxhash64("k")).limit(LABELLED)  # a bound for the broadcast
    d = docs.select(F.col("doc_id").cast("long").alias("k"), "text").where("k is not null and text is not null")
    joined = d.join(F.broadcast(marked), "k", "left").select("k", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"), "text")
    read = table(joined.mapInArrow(_read, "k long, labels array<int>, words array<long>, sizes array<int>"), "read")
    v = vocabulary(read, len(subjects), read.count())
    if not len(v):
        return docs.sparkSession.createDataFrame([], "doc_id long, subject string, n int, share double, weight double")
    known = sc.broadcast(v["t"].to_numpy().view(np.uint64))
    numbered = table(read.mapInArrow(_number(known), "k long, term array<int>, count array<float>, at array<int>, sizes array<int>"), "numbered")
    discard(read)
    h = factor(numbered, v, len(subjects))
    out = table(numbered.mapInArrow(_assign(sc.broadcast(h), subjects), "doc_id long, subject string, n int, share double, weight double"), "shares")
    discard(numbered)
    known.destroy()
    return out


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: list[str], least_share: float = 0.25) -> DataFrame:
    """``doc_id, subject`` for every subject on which at least ``least_share`` of the sentences on any subject are."""
    return subject_shares(docs, labels, subjects).where(F.col("share") >= least_share - 1e-9).select("doc_id", "subject").distinct()
