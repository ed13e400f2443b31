"""Sequence text: k-mers, alphabet cleaning, mature-domain trimming, ids and hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions.numeric import as_column

WHITESPACE = " \t\n\r\x0b\x0c"

# Fixed patterns: a terminal poly-histidine tag, and the suffix of a synthetic negative's id.
LEADING_HIS_TAG = r"^[MA]{0,3}H{5,}"
TRAILING_HIS_TAG = r"H{5,}$"
SYNTHETIC_SUFFIX = r"-(scramble|wrongtarget)\d+$"
ARCHIVE_MEMBER = r"^system_(\d+)_(\d+)_([0-9A-Za-z]+)_([0-9A-Za-z]+)_model_(\d+)\.pdb$"


def strip(text: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(as_column(text), F.lit(WHITESPACE))


def kmer_set(text: Column | str, k: int = C.KMER_LENGTH) -> Column:
    """Distinct substrings of length ``k``; an empty array for shorter text."""
    # A look-ahead captures k characters at every position in one pass over the text; cutting
    # substrings by position would rescan the text from its start each time.  The second group
    # keeps a match from starting inside a surrogate pair.
    pattern = rf"(?s)(?=(.{{{k}}}))(?![\uDC00-\uDFFF])"
    return F.array_distinct(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a & b| / |a | b| of two sets held as arrays of distinct items; 0 when either is empty."""
    a, b = as_column(a), as_column(b)
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    value = F.try_divide(shared.cast("double"), total.cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)


def identity_to_jaccard(identity: float, k: int = C.KMER_LENGTH) -> float:
    """k-mer Jaccard level that stands for a sequence identity: one substitution spoils k k-mers."""
    spoiled = k * max(0.0, 1.0 - identity)
    return max(0.0, (1.0 - spoiled) / (1.0 + spoiled))


def clean_sequence(text: Column | str) -> Column:
    """Upper-case and keep the twenty standard amino-acid letters."""
    return F.regexp_replace(F.upper(as_column(text)), f"[^{C.AMINO_ACIDS}]", "")


def strip_his_tags(text: Column | str) -> Column:
    without_lead = F.regexp_replace(as_column(text), LEADING_HIS_TAG, "")
    return F.regexp_replace(without_lead, TRAILING_HIS_TAG, "")


def normalize_antigen(text: Column | str, signals: Iterable[str] = C.SIGNAL_PEPTIDES) -> Column:
    """Trim, upper-case, drop one known signal peptide, then terminal His tags."""
    s = F.upper(strip(text))
    trimmed = s
    for signal in reversed(tuple(signals)):
        trimmed = F.when(s.startswith(signal), F.substring(s, len(signal) + 1, 1 << 30)).otherwise(
            trimmed
        )
    return strip_his_tags(trimmed)


def normalize_binder(text: Column | str, domain: Column | str | None = None) -> Column:
    """The variable domain when a numbering table supplies one, else the His-stripped text."""
    stripped = strip_his_tags(F.upper(strip(text)))
    return stripped if domain is None else F.coalesce(as_column(domain), stripped)


def normalize_chains(chains: Column | str) -> Column:
    """Multi-chain antigen: each chain normalised, joined by a colon."""
    return F.array_join(F.transform(as_column(chains), lambda c: normalize_antigen(c)), ":")


def hash16(text: Column | str) -> Column:
    """First 16 hex digits of SHA-1."""
    return F.substring(F.sha1(as_column(text).cast("binary")), 1, 16)


def unit_hash(*parts: Column | str) -> Column:
    """Uniform double in [0, 1) from the MD5 of the parts joined by '|' (52 leading bits)."""
    digest = F.md5(F.concat_ws("|", *[as_column(p).cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def chain_list(field: Column | str) -> Column:
    """'A | B' to ['A', 'B']; blank and 'NA' to an empty array."""
    c = F.coalesce(as_column(field), F.lit(""))
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(c == "NA", F.array().cast("array<string>")).otherwise(parts)


def windows(length: Column | str, size: int = C.WINDOW_LENGTH) -> Column:
    """Non-overlapping [start, stop) windows covering a length; an empty text gets one (0, 0)."""
    n = as_column(length).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(s + F.lit(size), F.greatest(n, F.lit(0))).alias("stop")),
    )


def sequence_identity(query: Column | str, chain: Column | str) -> Column:
    """1.0 for a substring match, else the share of equal positions over the shorter text."""
    q, c = as_column(query), as_column(chain)
    shorter = F.when(F.length(q) <= F.length(c), q).otherwise(c)
    longer = F.when(F.length(q) <= F.length(c), c).otherwise(q)
    n = F.length(shorter)
    hits = F.size(
        F.filter(
            F.sequence(F.lit(1), n),
            lambda i: F.substring(shorter, i, F.lit(1)) == F.substring(longer, i, F.lit(1)),
        )
    )
    return (
        F.when((F.length(q) == 0) | (F.length(c) == 0) | q.isNull() | c.isNull(), F.lit(0.0))
        .when(F.contains(longer, shorter), F.lit(1.0))
        .otherwise(hits.cast("double") / n.cast("double"))
    )


def pair_id(left: Column | str, right: Column | str) -> Column:
    """'{LEFT}__{RIGHT}', upper-cased."""
    return F.concat(F.upper(as_column(left)), F.lit("__"), F.upper(as_column(right)))


def pair_parts(pair: Column | str) -> Column:
    """Struct (left, right) of a pair id split at its first '__', upper-cased."""
    p = as_column(pair)
    at = F.instr(p, "__")
    left = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
    right = F.when(at > 0, F.substring(p, at + 2, F.length(p))).otherwise(F.lit(""))
    return F.struct(F.upper(left).alias("left"), F.upper(right).alias("right"))


def archive_member(name: Column | str) -> Column:
    """Struct (system_i, system_j, vhh_pdb, antigen_pdb, model); NULL for other file names."""
    n = as_column(name)
    part = lambda i: F.regexp_extract(n, ARCHIVE_MEMBER, i)
    return F.when(
        n.rlike(ARCHIVE_MEMBER),
        F.struct(
            part(1).try_cast("int").alias("system_i"),
            part(2).try_cast("int").alias("system_j"),
            part(3).alias("vhh_pdb"),
            part(4).alias("antigen_pdb"),
            part(5).try_cast("int").alias("model"),
        ),
    )


def parent_id(example_id: Column | str) -> Column:
    """Id of the real example a synthetic negative was made from."""
    return F.regexp_replace(as_column(example_id), SYNTHETIC_SUFFIX, "")


def split_roles(chains: Column | str, binder_format: Column | str, name: Column | str) -> Column:
    """Struct (binder, target): a Fab has two binder chains, others one; an empty side raises."""
    c = as_column(chains)
    n = F.when(as_column(binder_format) == "fab", F.lit(2)).otherwise(F.lit(1))
    message = F.concat(as_column(name), F.lit(": cannot split chains into binder and target"))
    return F.when(
        F.size(c) > n,
        F.struct(F.slice(c, F.lit(1), n).alias("binder"), F.slice(c, n + 1, F.size(c)).alias("target")),
    ).otherwise(F.raise_error(message))


def chain_letters(start: Column | int, count: Column) -> Column:
    """Positional chain ids A, B, C ... for ``count`` chains after ``start``; past Z raises."""
    first = start if isinstance(start, Column) else F.lit(start)
    letters = F.when(
        count > 0,
        F.transform(F.sequence(first, first + count - 1), lambda i: F.char(F.lit(65) + i)),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(first + count <= 26, letters).otherwise(
        F.raise_error(F.lit("too many chains for single-letter labels"))
    )
