"""Query text: cleaning, variants, prompts, word forms, pre-tokens, token ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.config import PAGE_SIZE

# Words around a query, special tokens, and the pattern that splits text before byte-pair merges.
VARIANTS = ("%s", "a photo of %s", "a picture of %s", "%s photo")
PREFIX, BLANK_QUERY = "a photo of ", "a photo"
UNNAMED = "Unnamed album"
BOS, EOS, LENGTH = 49406, 49407, 77
PRETOKEN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
TEMPLATES = (
    "a photo of a %s",
    "a photo of the %s",
    "a close-up photo of a %s",
    "a cropped photo of a %s",
    "a blurry photo of a %s",
    "a low quality photo of a %s",
    "a bright photo of a %s",
    "a photo of one %s",
    "a photo of many %s",
    "%s",
)


def of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(of(c), r"\s+", " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(collapse(c)) == 0, F.lit(True))


def fill(templates: tuple[str, ...], c: Column) -> list[Column]:
    return [F.concat(F.lit(t.split("%s")[0]), c, F.lit(t.split("%s")[1])) for t in templates]


def query_variants(c: Column | str) -> Column:
    """The distinct variants of a query in order; a blank one stands alone as it came."""
    q = collapse(c)
    return F.when(is_blank(c), F.array(of(c))).otherwise(F.array_distinct(F.array(*fill(VARIANTS, q))))


def normalize_query(c: Column | str) -> Column:
    """What the tokenizer sees: the prefix put before all that don't have it, lower-cased; later variants may coincide."""
    q = F.lower(collapse(c))
    return F.when(is_blank(c), BLANK_QUERY).when(q.startswith(PREFIX), q).otherwise(F.concat(F.lit(PREFIX), q))


def pretokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(of(c)), F.lit(PRETOKEN), F.lit(0))


def encode_ids(ids: Column | str) -> Column:
    """BOS, ids as far as they fit, EOS and zeros, LENGTH in all."""
    body = F.slice(of(ids), 1, LENGTH - 2)
    full = F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS))).cast("array<bigint>")
    return F.slice(F.concat(full, F.array_repeat(F.lit(0).cast("bigint"), LENGTH)), 1, LENGTH)


def attention_mask(ids: Column | str) -> Column:
    """One for each id that encode_ids() puts there, padding zero."""
    real = F.least(F.size(of(ids)) + 2, F.lit(LENGTH))
    return F.transform(F.sequence(F.lit(1), F.lit(LENGTH)), lambda i: (i <= real).cast("bigint"))


def tool_ids(ids: Column | str) -> Column:
    """The offline tools' way: special tokens around, cut to LENGTH with EOS at the end, zeros behind."""
    full = F.concat(F.array(F.lit(BOS)), of(ids), F.array(F.lit(EOS))).cast("array<bigint>")
    cut = F.when(F.size(full) > LENGTH, F.concat(F.slice(full, 1, LENGTH - 1), F.array(F.lit(EOS).cast("bigint")))).otherwise(full)
    return F.slice(F.concat(cut, F.array_repeat(F.lit(0).cast("bigint"), LENGTH)), 1, LENGTH)


def tool_mask(padded: Column | str) -> Column:
    """Their mask: ids that aren't zero, so a real id 0 counts as padding."""
    return F.transform(of(padded), lambda x: (x != 0).cast("bigint"))


def cleaned(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(of(c), r"^\s+|\s+$", ""))


def expand_number(c: Column | str) -> Column:
    """The query, its singular by ending, and with an s if it has none: the distinct ones in this order."""
    q = cleaned(c)
    single = (
        F.when(q.endswith("ies"), F.regexp_replace(q, "ies$", "y"))
        .when(q.endswith("es") & (F.length(q) > 3), F.regexp_replace(q, "es$", ""))
        .when(q.endswith("s") & ~q.endswith("ss"), F.regexp_replace(q, "s$", ""))
        .otherwise(q)
    )
    return F.array_distinct(F.array(q, single, F.when(q.endswith("s"), q).otherwise(F.concat(q, F.lit("s")))))


def head_noun(c: Column | str) -> Column:
    """The last word."""
    return F.element_at(F.split(cleaned(c), r"\s+"), -1)


def prompts(c: Column | str) -> Column:
    """Every number form in every template: the distinct ones in order."""
    return F.array_distinct(F.flatten(F.transform(expand_number(c), lambda q: F.array(*fill(TEMPLATES, q)))))


def album_name(c: Column | str) -> Column:
    return F.when(is_blank(c), UNNAMED).otherwise(of(c))


def visible_text(n: Column | str) -> Column:
    n = of(n)
    return F.when(n == 0, "No photos found").when(n == 1, "1 photo").otherwise(F.concat(n.cast("string"), F.lit(" photos")))


def found_text(n: Column | str) -> Column:
    n = of(n)
    found = F.concat(F.lit("Found "), n.cast("string"), F.lit(" photos"))
    return F.when(n == 0, "No results found").when(n <= PAGE_SIZE, found).otherwise(F.concat(found, F.lit(" \u2014 scroll to see more")))


def summary_text(n_indexed: Column | str, n_selected: Column | str) -> Column:
    """The state line: no selection is all albums."""
    albums = F.when(of(n_selected) == 0, "All albums").otherwise(F.concat(of(n_selected).cast("string"), F.lit(" albums")))
    return F.concat(F.lit("Ready - "), of(n_indexed).cast("string"), F.lit(" indexed ("), albums, F.lit(")"))


def album_label(name: Column | str, n: Column | str) -> Column:
    return F.concat(of(name), F.lit(" ("), of(n).cast("string"), F.lit(")"))


def name_match(names: Column | str, word: str) -> Column:
    """The first name that holds the word, whatever its case; else the first."""
    names = of(names)
    return F.coalesce(F.try_element_at(F.filter(names, lambda x: F.lower(x).contains(word)), F.lit(1)), F.try_element_at(names, F.lit(1)))
