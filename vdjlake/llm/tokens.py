"""Token ids of a whole corpus by a public byte-level BPE tokenizer.

Overlapping chunk encoding. A long text is cut into chunks that overlap;
chunks of one text are pre-tokenised in parallel. A match of the pre-token
pattern depends only on what follows its start, so from the first start that
two neighbouring chunks have in common in their overlap, they agree: there the
pieces are stitched. Each stitched piece is whole pre-tokens and is encoded by
itself; the ids are put together in order. Decoding concatenates the raw bytes.

Where two chunks have no common start (one pre-token longer than the overlap),
the text runs on as one piece from its last stitch to its next certain start.
A start is certain, whatever came before it, where white space follows a
character that is none: no pre-token spans that place.

Long texts are named by their SHA-256, so equal ones are encoded once and every
row gets the ids of its own text, whatever its key: the key takes part in no
join. A long text is cut into chunks in one pass over its letters.

Defined cases: null and empty texts have the empty list; strings that look like
special tokens are ordinary text; a text of any length is encoded whole; there
is one row for each input row, also where keys repeat (with equal or differing
texts) or are null; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjlake.session import shuffle_partitions

#: Folder with the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("VDJLAKE_TOKENIZERS", "/opt/tokenizers")
#: Characters of a chunk, and by how many the next one is seen as well.
CHUNK, OVERLAP = 16_384, 1_024

# fixed values: the pre-token pattern of the byte_bpe vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tokenizer without special tokens; loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def starts(text: str) -> list[int]:
    """Starts of the pre-tokens of a text where it may be cut: those that follow no white space.

    The pattern looks ahead only past white space, so a piece that ends in
    another character is cut into the same pre-tokens by itself.
    """
    return [m.start() for m in _pattern().finditer(text) if m.start() and not _space().match(text, m.start() - 1)]


@functools.lru_cache(maxsize=1)
def _space():
    import regex

    return regex.compile(r"\s")


@functools.lru_cache(maxsize=1)
def _certain():
    import regex

    return regex.compile(r"(?<=\S)\s")


def certain(text: str, upto: int) -> int | None:
    """The first place up to ``upto`` where a pre-token starts whatever the text before holds."""
    m = _certain().search(text)
    return m.start() if m and m.start() <= upto else None


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of ids: their raw bytes one after the other."""
    e = encoding(name, folder)
    return b"".join(e.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def _encode(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its ids."""
    e = encoding(name, folder)
    for b in batches:
        # a few texts at a time, so that memory follows the largest text and not the batch
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            ids = [e.encode_ordinary(t) if t else [] for t in part.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, type=pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "ids"])


def _count(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by the number of its ids."""
    e = encoding(name, folder)
    for b in batches:
        n = [len(e.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.columns[-1]]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, type=pa.int64())], names=[*b.schema.names[:-1], "tokens"])


_CHUNK = pa.schema([("h", pa.string()), ("chunk", pa.int32()), ("text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of each text (h, text), a few at a time."""
    for b in batches:
        for h, text in zip(*(c.to_pylist() for c in b.columns)):
            n = -(-len(text) // chunk)
            for lo in range(0, n, 64):
                at = range(lo, min(n, lo + 64))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(at)), pa.array(at, type=pa.int32()), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in at])], schema=_CHUNK)


_CUTS = pa.schema([("h", pa.string()), ("chunk", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())), ("sure", pa.int32())])


def _pretokenise(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Per chunk the pre-token starts in both overlaps and its first certain start, all relative to the cut.

    A row's text holds ``chunk`` characters from its cut on, then ``overlap``
    characters of the next chunk. A start is not trusted as a tail's when the
    match before it ran into the end of the text.
    """
    for b in batches:
        rows = []
        for h, n, text in zip(*(c.to_pylist() for c in b.columns)):
            s = starts(text)
            head = [x for x in s if x <= overlap]
            tail = [x - chunk for x in s if x >= chunk]
            rows.append((h, n, head, tail, certain(text, chunk - 1)))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _CUTS)] if rows else [pa.array([], type=f.type) for f in _CUTS], schema=_CUTS)


def pieces(long: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``h, piece, text`` of distinct texts (h, text): stitched pieces made of whole pre-tokens.

    The chunks go through one exchange, which their pre-tokenising and the
    cutting of the pieces share; the windows see starts only.
    """
    n = shuffle_partitions(long.sparkSession)
    chunks = long.select("h", "text").mapInArrow(functools.partial(_cut, chunk=chunk, overlap=overlap), "h string, chunk int, text string").repartition(n, "h", "chunk")
    cuts = chunks.mapInArrow(functools.partial(_pretokenise, chunk=chunk, overlap=overlap), "h string, chunk int, head array<int>, tail array<int>, sure int")
    w = Window.partitionBy("h").orderBy("chunk")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("tail").over(w)
    # the last start of a tail may be an artefact of the chunk's end
    common = F.array_min(F.array_intersect(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), F.col("head")))
    stitched = cuts.withColumn("common", common)
    # a common start holds if the chunk before was stitched itself; a certain start always holds
    whole = F.sum(F.when(F.col("common").isNull() & (F.col("chunk") > 0), 1).otherwise(0)).over(upto) == 0
    begin = F.when(F.col("chunk") == 0, F.lit(0)).when(whole, F.col("common")).otherwise(F.col("sure"))
    begins = stitched.select("h", "chunk", begin.alias("begin"))
    # a chunk without a start belongs to the piece that runs on; what lies before a start, to the piece before
    after = F.lead("begin").over(w)
    spans = begins.select(
        "h",
        "chunk",
        "begin",
        F.count("begin").over(upto).cast("int").alias("piece"),
        F.lead("chunk").over(w).isNull().alias("last"),
        after.alias("after"),
    )
    whole_text = spans.join(chunks, ["h", "chunk"])
    # what a chunk shows up to its own start, if the chunk before did not show it, ends the piece before
    upto_next = F.when(F.col("last"), F.length("text")).otherwise(F.lit(chunk) + F.when(F.col("after") <= overlap, F.col("after")).otherwise(0))
    early = F.when((F.col("begin") > overlap), F.struct((F.col("piece") - 1).alias("piece"), "chunk", F.substr("text", F.lit(1), F.col("begin")).alias("text")))
    own = F.struct("piece", "chunk", F.substr("text", F.coalesce("begin", F.lit(0)) + 1, upto_next - F.coalesce("begin", F.lit(0))).alias("text"))
    parts = whole_text.select("h", F.explode(F.filter(F.array(early, own), lambda x: x.isNotNull())).alias("x")).select("h", "x.piece", "x.chunk", "x.text")
    joined = parts.groupBy("h", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("p"))
    return joined.select("h", "piece", F.array_join("p.text", "").alias("text"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _long(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(k, h of the rows above a chunk; their distinct texts as h, text)."""
    named = rows.where(F.length("text") > chunk).withColumn("h", F.sha2("text", 256))
    return named.select("k", "h"), named.groupBy("h").agg(F.first("text").alias("text"))


def count_tokens(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``<key>, tokens`` for every distinct key: the length of its ids, of the longest where a key repeats."""
    rows = _rows(docs, key, text)
    run = functools.partial(_count, name=name, folder=folder)
    short = rows.where(F.length("text") <= chunk).mapInArrow(run, "k long, tokens long")
    at, texts = _long(rows, chunk)
    sizes = pieces(texts, chunk, overlap).select("h", "text").mapInArrow(run, "h string, tokens long").groupBy("h").agg(F.sum("tokens").alias("tokens"))
    return short.unionByName(at.join(sizes, "h").select("k", "tokens")).groupBy("k").agg(F.max("tokens").alias("tokens")).withColumnRenamed("k", key)


def encode(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``<key>, ids`` for every row; texts longer than a chunk are encoded in stitched pieces."""
    rows = _rows(docs, key, text)
    run = functools.partial(_encode, name=name, folder=folder)
    short = rows.where(F.length("text") <= chunk).mapInArrow(run, "k long, ids array<int>")
    at, texts = _long(rows, chunk)
    parts = pieces(texts, chunk, overlap).mapInArrow(run, "h string, piece int, ids array<int>")
    whole = parts.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).select("h", F.flatten(F.col("p.ids")).alias("ids"))
    return short.unionByName(at.join(whole, "h").select("k", "ids")).withColumnRenamed("k", key)
