"""Scalar text functions of variants: keys, identifiers, labels, sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ontologies whose ids occur in annotation texts.
ONTOLOGIES = ["MONDO", "OMIM", "Orphanet", "MedGen", "MeSH"]


def variant_key(chrom: Column, start: Column, ref: Column, alt: Column, end: Column | None = None) -> Column:
    """chr{c}:{start}-{end}_{REF}_{ALT}; without an end it is start + length of REF. Null parts give a null key (P-01)."""
    stop = end if end is not None else start + F.length(ref)
    bare = F.regexp_replace(chrom.cast("string"), "^chr", "")
    return F.concat(F.lit("chr"), bare, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"), F.lit("_"), ref, F.lit("_"), alt)


def parse_key(key: Column) -> dict[str, Column]:
    """chrom, start and end of a variant key; null where the key has another form (F-06)."""
    part = lambda k: F.nullif(F.regexp_extract(key, r"^(chr[^:]+):(\d+)-(\d+)_", k), F.lit(""))
    return {"chrom": part(1), "start": part(2).try_cast("long"), "end": part(3).try_cast("long")}


def short_site(key: Column) -> Column:
    """chr:pos REF>ALT, or the key unchanged (F-07)."""
    return F.regexp_replace(key, r"^(chr[^:]+):(\d+)-\d+_([^_]+)_([^_]+)$", r"$1:$2 $3>$4")


def info_field(info: Column, name: str) -> Column:
    """Value of a field of an INFO text, null when absent (IO-02)."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){name}=([^;]+)", 1), F.lit(""))


def ontology_ids(text: Column, ontology: str) -> Column:
    """All ids of an ontology in a text; an empty array when none (F-01, F-02)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"({ontology}:[^,|]+)"), F.lit(1)), F.array().cast("array<string>"))


def first_part(text: Column, separator: str) -> Column:
    """Text before the first separator (F-04, IO-22)."""
    return F.substring_index(text, separator, 1)


def split_ends(text: Column, separator: str = "|") -> tuple[Column, Column]:
    """First and last part of a separated text (F-03)."""
    parts = F.split(text, rf"\{separator}")
    return F.element_at(parts, 1), F.element_at(parts, -1)


def fix_prefix(text: Column, prefix: str = "MONDO:") -> Column:
    """Doubled prefixes of a |-separated list are made single (F-05)."""
    return F.array_join(F.transform(F.split(text, r"\|"), lambda x: F.replace(x, F.lit(prefix * 2), F.lit(prefix))), "|")


def transcribe(dna: Column) -> Column:
    """DNA to RNA in lower case (F-10)."""
    return F.lower(F.translate(dna, "Tt", "Uu"))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGT", "TGCA"))  # F-14


def one_hot(dna: Column) -> Column:
    """An array of four 0/1 values (A, C, G, T) for each base; other letters are zeros (F-12)."""
    return F.transform(F.split(dna, ""), lambda b: F.array(*((b == x).cast("int") for x in "ACGT")))


def wildcard_id(identifier: Column) -> Column:
    return F.concat(F.lit("*"), F.replace(identifier, F.lit(":"), F.lit("_")))  # F-42


def file_chromosome(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(chr(?:[0-9]+|[XYM]))", 1), F.lit(""))  # F-43, IO-18


def significance_class(text: Column) -> Column:
    """benign, pathogenic (also when a text says both) or other; null texts are other (P-13)."""
    low = F.lower(text)
    return F.when(low.contains("pathogenic"), "pathogenic").when(low.contains("benign"), "benign").otherwise("other")


def contains_any_case(text: Column, word: str) -> Column:
    """Whether a text contains a word in any case; false for null texts (P-12)."""
    return F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))


def first_filled(columns: list[Column], separator: str = ",") -> Column:
    """The first column that isn't null, up to the first separator (P-22)."""
    return F.substring_index(F.coalesce(*columns), separator, 1)


def bare_chromosome(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")  # J-19


def site_coords(chrom: Column, start: Column, end: Column, ref: Column, alt: Column) -> dict[str, Column]:
    """chrom (with chr), start, end and the name of a site (F-08)."""
    named = F.concat(F.lit("chr"), bare_chromosome(chrom))
    label = F.concat_ws("_", F.concat(named, F.lit(":"), start, F.lit("-"), end), ref, alt)
    return {"chrom": named, "start": start, "end": end, "site_name": label}


def hgvs_label(key: Column) -> Column:
    """g.{start}{REF}>{ALT} of a variant key (F-09)."""
    part = F.split(key, ":|-|_")
    return F.concat(F.lit("g."), part[1], part[3], F.lit(">"), part[4])


def to_bytes(text: Column) -> Column:
    """Codes of the characters of an ASCII text (F-11)."""
    return F.transform(F.split(text, ""), F.ascii)


def from_bytes(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def one_hot_channels(dna: Column) -> Column:
    """Four arrays (A, C, G, T) of 0 and 1 over the bases: channels first (F-13)."""
    is_base = lambda b: F.transform(F.split(dna, ""), lambda c: (c == b).cast("float"))
    return F.array(*map(is_base, "ACGT"))


def score_type(index: Column) -> dict[str, Column]:
    """Type and strand of one of eight splice scores by its place, from 0 (F-40)."""
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))
    kinds = ["acceptor_gain", "acceptor_loss", "donor_gain", "donor_loss"]
    return {"kind": at(kinds * 2), "strand": at(["pos"] * 4 + ["neg"] * 4)}


def recode(value: Column, table: dict[str, str], default: str = "other") -> Column:
    """Value by a fixed table, with a default for the rest (P-07)."""
    return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), reversed(list(table.items())), F.lit(default))
