"""Sequence, gene and label functions as column expressions (no Python in the row path)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- genes


def strip_allele(c: Column | str) -> Column:
    """Text before the first ``*``."""
    return F.substring_index(_c(c), "*", 1)


def v_family(c: Column | str) -> Column:
    """``IGHV3`` of ``ighv3-49*01``; null where the text starts otherwise."""
    f = F.upper(F.regexp_extract(_c(c), r"(?i)^(IG[HKL]V\d+)", 1))
    return F.when(f != "", f)


def j_family(c: Column | str) -> Column:
    """``IGHJ4``; heavy chains only and case-sensitive, so light chains have none."""
    f = F.regexp_extract(_c(c), r"^(IGHJ\d+)", 1)
    return F.when(f != "", f)


#: fixed values: classes in the order they are reported, with the prefixes of their genes
IG_CLASSES = (("IgM", "IGHM"), ("IgD", "IGHD"), ("IgG", "IGHG"), ("IgA", "IGHA"), ("IgE", "IGHE"))


def ig_class(c: Column | str) -> Column:
    """Immunoglobulin class of a constant-region call, null for any other."""
    u = F.upper(_c(c))
    out = F.lit(None).cast("string")
    for name, prefix in reversed(IG_CLASSES):
        out = F.when(u.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def chain(c: Column | str) -> Column:
    """Heavy, Kappa or Lambda: by the locus prefix, else by the letters L and K, else heavy."""
    u = F.upper(_c(c))
    locus = F.regexp_extract(u, r"^IG([HKL])", 1)
    return (
        F.when(locus == "H", "Heavy").when(locus == "K", "Kappa").when(locus == "L", "Lambda").when(u.contains("L"), "Lambda").when(u.contains("K"), "Kappa").otherwise("Heavy")
    )


def locus_code(c: Column | str) -> Column:
    """``VH3-49`` of ``IGHV3-49*01``: segment letter, chain letter, then the name up to ``*``; null without allele."""
    g = _c(c)
    star = F.instr(g, "*")
    return F.when((F.length(g) > 4) & (star > 0), F.concat(F.substring(g, 4, 1), F.substring(g, 3, 1), F.substr(g, F.lit(5), F.greatest(star - 5, F.lit(0)))))


# ---- nucleotides and amino acids

# fixed values: the standard genetic code, codons in the order of the bases T, C, A, G
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _AMINO)}


def translate(c: Column | str) -> Column:
    """Amino acids up to the first stop codon; gaps removed, unknown codons are X, an open end is cut."""
    dna = F.upper(F.regexp_replace(_c(c), r"[-.\s]", ""))
    n = F.floor(F.length(dna) / 3).cast("int")
    code = F.create_map(*[F.lit(x) for kv in _CODONS.items() for x in kv])
    amino = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.element_at(code, F.substr(dna, (i - 1) * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(dna.isNotNull(), F.when(n > 0, F.substring_index(F.array_join(amino, ""), "*", 1)).otherwise(""))


def region(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    """Letters from a 1-based start to an end, both included; the whole ends where either is null."""
    s, a, b = _c(seq), F.coalesce(_c(start), F.lit(1)), F.coalesce(_c(end), F.length(_c(seq)))
    return F.substr(s, a, F.greatest(b - a + 1, F.lit(0)))


def imgt_cdr3(c: Column | str) -> Column:
    """Junction without one leading C and one trailing W or F."""
    return F.regexp_replace(F.regexp_replace(_c(c), "^C", ""), "[WF]$", "")


def _mismatches(a: Column, b: Column, skip: str = "") -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x != y) & (~x.isin(*skip) & ~y.isin(*skip) if skip else F.lit(True))).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places of texts of equal length, else null."""
    x, y = _c(a), _c(b)
    return F.when(F.length(x) == F.length(y), F.when(F.length(x) == 0, F.lit(0)).otherwise(_mismatches(x, y)))


def hamming_similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the differing part; 0 for unequal lengths or empty texts."""
    x = _c(a)
    return F.coalesce(F.when(F.length(x) > 0, 1 - hamming(a, b) / F.length(x)), F.lit(0.0))


def identity_percent(a: Column | str, b: Column | str) -> Column:
    """Equal places in percent; 0 for unequal lengths or empty texts."""
    x = _c(a)
    return F.coalesce(F.when(F.length(x) > 0, (F.length(x) - hamming(a, b)) / F.length(x) * 100), F.lit(0.0))


def aa_similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the edited part of the longer text, minus half the length gap's part where it exceeds 2; 0 if either is empty."""
    x, y = _c(a), _c(b)
    longest = F.greatest(F.length(x), F.length(y))
    gap = F.abs(F.length(x) - F.length(y))
    s = 1 - (F.levenshtein(x, y) / longest + F.when(gap > 2, gap / longest).otherwise(0.0) * 0.5)
    return F.coalesce(F.when((F.length(x) > 0) & (F.length(y) > 0), F.greatest(F.lit(0.0), s)), F.lit(0.0))


def shm(sequence: Column | str, germline: Column | str) -> Column:
    """Mismatches of two alignments, places with ``.`` or ``N`` in either left out; null unless equally long."""
    x, y = F.upper(_c(sequence)), F.upper(_c(germline))
    return F.when((F.length(x) == F.length(y)) & (F.length(x) > 0), _mismatches(x, y, ".N"))


def alignment(a: Column | str, b: Column | str) -> Column:
    """Struct: both texts padded with ``-``, a match string, matches and length."""
    x, y = _c(a), _c(b)
    n = F.greatest(F.length(x), F.length(y))
    px, py = F.rpad(x, n, F.lit("-")), F.rpad(y, n, F.lit("-"))
    marks = F.zip_with(F.split(px, ""), F.split(py, ""), lambda p, q: F.when((p == q) & (p != "-"), "|").otherwise(" "))
    text = F.when(n > 0, F.array_join(marks, "")).otherwise("")
    return F.struct(px.alias("query"), text.alias("marks"), py.alias("target"), F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("matches"), n.alias("length"))


def content(c: Column | str) -> Column:
    """Upper case without gaps and N: the form in which sequences are equal in content."""
    return F.translate(F.upper(_c(c)), "-N", "")


def is_protein(c: Column | str) -> Column:
    """Any letter outside A, C, G, N, T."""
    return F.upper(_c(c)).rlike("[^ACGNT]")


# ---- identifiers and labels


def file_suffix(c: Column | str) -> Column:
    """Digits after the last ``_``; null where there are none."""
    s = F.regexp_extract(_c(c), r"_(\d+)$", 1)
    return F.when(s != "", s)


def without_suffix(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"_\d+$", "")


def patient(file: Column | str, timepoint: Column | str, original: Column | str | None = None) -> Column:
    """File name without extension, leading ``T<n>_`` and trailing ``_<timepoint>``."""
    f = F.regexp_replace(_c(file), r"^T\d+_", "") if original is None else F.coalesce(_c(original), F.regexp_replace(_c(file), r"^T\d+_", ""))
    base = F.regexp_replace(f, r"\.(fasta|fa|csv|tsv)$", "")
    tail = F.concat(F.lit("_"), _c(timepoint))
    return F.when(base.endswith(tail), F.substr(base, F.lit(1), F.length(base) - F.length(tail))).otherwise(base)


def slug(c: Column | str, default: str = "item") -> Column:
    """Lower case, runs of other characters than letters and digits as one ``-``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(default))


def default_id(seq_id: Column | str, cell: Column | str, locus: Column | str) -> Column:
    """The identifier, or ``<cell>_<locus>`` where it is empty."""
    s = _c(seq_id)
    return F.coalesce(F.when(F.trim(s) != "", s), F.concat_ws("_", _c(cell), _c(locus)))


def clip(c: Column | str, n: int) -> Column:
    """The first ``n`` characters, with ``...`` where more follow."""
    s = _c(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def clean_label(c: Column | str) -> Column:
    """Tip label without a legacy ``|||`` tail and a trailing ``_n`` or `` n``."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"\|\|\|.*$", ""), r"[_ ]\d+$", ""))


def newick_leaves(c: Column | str) -> Column:
    """Names in a Newick string that are not numbers."""
    names = F.regexp_extract_all(_c(c), F.lit(r"[^(),:;\s]+"), F.lit(0))
    return F.filter(names, lambda x: ~x.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))


def natural_key(c: Column | str) -> Column:
    """Struct that sorts labels naturally: letters without digits, then the first number, then the text."""
    s = _c(c)
    n = F.regexp_extract(s, r"(\d+)", 1)
    return F.struct(F.lower(F.regexp_replace(s, r"\d+", "")).alias("letters"), F.when(n != "", n.cast("long")).alias("number"), s.alias("text"))


def fixed(c: Column | str, digits: int) -> Column:
    """Decimal text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", _c(c).cast("double"))


def p_text(c: Column | str) -> Column:
    """``<0.001`` or three digits; ``n/a`` for null."""
    p = _c(c)
    return F.when(p.isNull(), "n/a").when(p < 0.001, "<0.001").otherwise(fixed(p, 3))


def stars(c: Column | str) -> Column:
    """``***``, ``**``, ``*`` below 0.001, 0.01, 0.05, else ``ns``."""
    p = _c(c)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def to_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def from_json(c: Column | str, schema: str) -> Column:
    return F.from_json(_c(c), schema)
