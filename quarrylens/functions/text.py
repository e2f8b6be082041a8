"""Text kernel: normalisation, n-grams, tokens, snippets, entropy, sizes. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalisation folds and deletes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "-_./\\:;|+~*% "
WORD_RUN = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often a lambda in ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(c: Column) -> Column:
    """ASCII lower case without separators; other letters are left as they are."""
    return F.translate(c, UPPER + SEPARATORS, LOWER)


def norm_offsets(c: Column) -> Column:
    """0-based places in a text of the characters its normal form keeps, so a place in the one is found in the other."""
    kept = F.transform(F.split(c, ""), lambda x, i: F.when(F.instr(F.lit(SEPARATORS), x) == 0, i))
    return F.filter(kept, lambda i: i.isNotNull())


def bytes_view(c: Column) -> Column:
    """The low octet of each UTF-16 unit of a text."""
    return F.unhex(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "..(..)", "$1"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trigrams(norm: Column, most: int = 64) -> Column:
    """Contiguous trigrams, at most ``most``; a text of under three characters is its own; none for an empty one."""
    n = F.length(norm)
    grams = F.transform(F.sequence(F.lit(1), F.least(n - 2, F.lit(most))), lambda i: F.substring(norm, i, F.lit(3)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(norm)).otherwise(grams)


def tokenize(norm: Column, most: int = 24) -> Column:
    """Runs of ASCII letters, digits and characters above 127, of 2 to 64 characters, at most ``most``."""
    runs = F.regexp_extract_all(norm, F.lit(WORD_RUN), F.lit(0))
    return F.slice(F.filter(runs, lambda t: F.length(t).between(2, 64)), 1, most)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset within its line."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(F.regexp_replace(head, r"(?s)\A.*\n", "")) + 1


def snippet(text: Column, start: Column, length: Column, around: int = 60) -> Column:
    """The match with up to ``around`` characters on either side, ellipses where text was left out."""
    begin = F.greatest(start - around, F.lit(0))
    stop = F.least(start + length + around, F.length(text))
    body = F.substring(text, begin + 1, stop - begin)
    return F.concat(F.when(begin > 0, "…").otherwise(""), body, F.when(stop < F.length(text), "…").otherwise(""))


def shannon(s: Column) -> Column:
    """Bits per character over the frequencies of characters; 0 for an empty or null text."""
    n = F.length(F.coalesce(s, F.lit(""))).cast("double")

    def bits(kept: Column) -> Column:
        counts = F.transform(F.array_distinct(kept), lambda c: F.size(F.filter(kept, lambda x: x == c)).cast("double"))
        return F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))

    chars = F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: F.length(c) > 0)
    return F.when(n == 0, F.lit(0.0)).otherwise(let(chars, bits))


def format_bytes(n: Column) -> Column:
    """B, KB or MB with a base of 1024."""
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))


def display_name(text: Column, most: int = 120) -> Column:
    """One line of at most ``most`` characters."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def provenance(url: Column, route: Column, method: Column) -> Column:
    """``url → route → via method`` of what there is."""
    some = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(" → ", some(url), some(route), F.concat(F.lit("via "), some(method)))


def add_line_numbers(code: Column) -> Column:
    lines = F.split(code, "\n", -1)
    width = F.greatest(F.lit(3), F.length(F.size(lines).cast("string")))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")


def is_noise(s: Column) -> Column:
    """Digits and punctuation only, or a colour."""
    return s.rlike(r"\A[0-9.,;:\s]+\z|\A#[0-9a-fA-F]{1,8}\z")


def control_share(s: Column) -> Column:
    """Share of characters that are neither printable nor white space."""
    shown = F.length(F.regexp_replace(s, r"[\x00-\x08\x0E-\x1F\x7F\x{FFFD}]", ""))
    return F.when(F.length(s) > 0, 1 - shown / F.length(s)).otherwise(F.lit(0.0))


def is_binary_text(s: Column) -> Column:
    """Neither JSON nor, for the most part, printable, nor with the signs of markup or code near its beginning."""
    head = F.substring(s, 1, 2048)
    structured = head.rlike(r"\A\s*[\[{<]") & head.rlike(r"[\]}>:;=]")
    return F.coalesce((control_share(head) > 0.15) & ~structured, F.lit(False))


def header_lines(headers: Column) -> Column:
    """A map as ``name: value`` lines, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def parse_header_lines(text: Column, most: int = 64) -> Column:
    """``name: value`` lines as a map; lines without a colon are left out and the first of a name is kept."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, ":") > 1), 1, most)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"\A[^:]*:", "")).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(first)
