"""Header tags, names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats of header tags.
GI, TAX, NAME, CLASS = "gi|", "<idTAX|", "<name|", "<class|"
LINE = 65


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extract_gi(header: Column) -> Column:
    """The number between the first gi| and the next |, or null."""
    return F.regexp_extract(header, r"^.*?gi\|([0-9]{1,18})\|", 1).try_cast("bigint")


def append_tax_tag(header: Column, tax_id: Column) -> Column:
    """A header without a taxon stays as it is."""
    return F.when(tax_id.isNull(), header).otherwise(F.concat(header, F.lit(f" {TAX}"), tax_id.cast("string"), F.lit("| ")))


def taxid_from_header(header: Column) -> Column:
    """What stands between <idTAX| and the last |, or null."""
    return _none_if_empty(F.regexp_extract(header, r"<idTAX\|(.*)\|", 1))


def taxid_from_file(name: Column) -> Column:
    return _none_if_empty(F.regexp_extract(name, r"idTAX(.*)\.fa", 1))


def truth_tag(header: Column) -> Column:
    """What stands between the first <name| and the last |, or null."""
    return _none_if_empty(F.regexp_extract(header, r"^.*?<name\|(.*)\|", 1))


def class_tag(header: Column) -> Column:
    return _none_if_empty(F.regexp_extract(header, r"^.*?<class\|([^|]*)\|", 1))


def read_key(title: Column) -> Column:
    """The key by which reads and scores meet: trimmed, cut at <name|, right-trimmed, and cut at the first tab from the fourth sign on."""
    key = F.regexp_replace(title, r"^[ \t]+|[ \t]+$", "")
    key = F.regexp_replace(F.substring_index(key, NAME, 1), r"[ \t]+$", "")
    return F.concat(F.substring(key, 1, 3), F.regexp_replace(F.substring(key, 4, 1 << 30), r"(?s)\t.*$", ""))


def default_group(header: Column) -> Column:
    """The first run of digits behind the first gi, else 0."""
    found = F.regexp_extract(header, r"^.*?gi[^0-9]*([0-9]+)", 1)
    return F.when(found == "", F.lit("0")).otherwise(found)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """A file's name without .fa."""
    return F.regexp_replace(basename(path), r"\.fa$", "")


def sanitise_name(name: Column) -> Column:
    """/ becomes =, carriage returns go."""
    return F.replace(F.replace(name, F.lit("/"), F.lit("=")), F.lit("\r"), F.lit(""))


def wrap(seq: Column, width: int = LINE) -> Column:
    """Line feeds after every width signs but the last."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def name_group(name: Column) -> Column:
    """The part of a database's name before _NT_."""
    return F.substring_index(name, "_NT_", 1)


def contains_any(name: Column, parts: list[str]) -> Column:
    """Names that hold any of the parts; the default of the list is "_"."""
    out = F.lit(False)
    for p in parts or ["_"]:
        out = out | name.contains(p)
    return out


#: Fixed words: outputs whose name holds one of them aren't groups.
NOT_GROUPS = ("notknow", "FP", "TP", "NK", "MultiClass")


def is_group_output(name: Column) -> Column:
    return ~contains_any(name, list(NOT_GROUPS))


def output_name(reads: Column, prefix: Column, k: int, mc: int) -> Column:
    """Default name of a comparison's output: the reads' file up to its first dot, the database's prefix, k and the cutoff."""
    return F.concat(F.substring_index(basename(reads), ".", 1), F.lit("_"), prefix, F.lit(f"_k{k}_mc{mc}"))


def group_of_output(name: Column, parent: Column) -> Column:
    """A score file's group: its name without _k... and without its parent's prefix; an undef group keeps only that word."""
    bare = F.regexp_replace(name, r"_k[0-9].*$", "")
    own = bare.startswith(F.concat(parent, F.lit("_")))
    bare = F.when(own, F.substring(bare, F.length(parent) + 2, F.lit(1 << 30))).otherwise(bare)
    return F.when(bare.contains("undef"), F.lit("undef")).otherwise(bare)
