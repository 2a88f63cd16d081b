"""Query-text queries, and those that SQL can't express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as X
from halyard.functions.encode import encode_batches, hashing_encoder, text_encoder
from halyard.functions.image import MEAN, STD, preprocess
from halyard.functions.tokenizer import Merges, token_ids
from halyard.functions.vectors import from_half, norm, to_half
from halyard.operators import search as S
from halyard.plans.retrieval import rounded
from halyard.plans.tables import messy, table, texts, vectors
from halyard.sources.files import noise

SEP = "|"


def troubled(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", F.expr(messy()).alias("text"))


def listed(c: F.Column) -> F.Column:
    return F.array_join(c, SEP)


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return troubled(spark, d).select("id", listed(X.query_variants("text")).alias("variants"))


def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    return troubled(spark, d).select("id", F.posexplode(X.query_variants("text")).alias("nth", "variant")).withColumn("nth", F.col("nth").cast("long"))


def normalize_query(spark: SparkSession, d: str) -> DataFrame:
    return troubled(spark, d).select("id", X.normalize_query("text").alias("normalized"), X.is_blank("text").alias("blank"))


def pretokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.pretokens("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, SEP).alias("tokens"))


def plural_expand(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.expr("element_at(array('cities', 'Dresses', 'bus', 'grass', 'cat', ' boxes', 'es', 'photos of dogs'), n_nationkey % 8 + 1)").alias("text"))
    return words.select("id", listed(X.expand_number("text")).alias("forms"), X.head_noun("text").alias("head"))


def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", listed(X.prompts("text")).alias("prompts"))


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(1) + (F.col("p_partkey") % 90).cast("int")), lambda i: (i * 7 + F.col("p_partkey")) % 50).alias("ids"))


def pad_token_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = id_lists(spark, d).select("p_partkey", X.encode_ids("ids").alias("i"), X.attention_mask("ids").alias("m"))
    return rows.select("p_partkey", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("input_ids"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("mask"))


def tool_token_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = id_lists(spark, d).select("p_partkey", X.tool_ids("ids").alias("i"))
    return rows.select("p_partkey", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("input_ids"), F.array_join(F.transform(X.tool_mask("i"), lambda x: x.cast("string")), ",").alias("mask"))


def name_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.split(F.concat_ws(" ", F.upper("p_name"), "p_type"), " ").alias("names"))
    return rows.select("p_partkey", X.name_match("names", "ri").alias("name"))


def toy_merges() -> Merges:
    """A vocabulary small enough to read; a real one is the caller's."""
    lines = ["a n", "r e", "re d</w>", "an t", "s m", "sm al", "i n", "in g</w>", "not a merge", "w i"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {t: i for i, t in enumerate([*letters, *(c + "</w>" for c in letters), *("".join(x.split(" ")) for x in lines if len(x.split(" ")) == 2)])}
    return Merges.from_lines(vocab, lines)


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", token_ids(toy_merges())(F.col("text")).alias("ids"))
    return rows.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# Queries and their token ids, special tokens around them.
GOLDEN = (
    ("cat", "49406,320,1125,539,2368,49407"),
    ("dog at beach", "49406,320,1125,539,1929,536,2117,49407"),
    ("a photo of food", "49406,320,1125,539,1559,49407"),
    ("birthday cake", "49406,320,1125,539,1166,2972,49407"),
    ("screenshot of text", "49406,320,1125,539,12646,539,4160,49407"),
)


def query_token_ids(spark: SparkSession, d: str, vocabulary: str | None = None) -> DataFrame:
    """The whole path from a typed query to model input: prefixed, cut to pieces, merged by a vocabulary file, padded."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    merges = Merges.from_json(Path(vocabulary).read_text())
    asked = spark.createDataFrame([(q,) for q, _ in GOLDEN], "query string")
    rows = asked.select("query", token_ids(merges)(X.normalize_query("query")).alias("ids"))
    rows = rows.select("query", X.encode_ids("ids").alias("i"), X.attention_mask("ids").alias("m"))
    real = F.transform(F.slice("i", F.lit(1), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).cast("int")), lambda x: x.cast("string"))
    return rows.select("query", F.array_join(real, ",").alias("ids"), F.size("i").cast("long").alias("padded"))


def text_encode_stub(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are of length one, or zero where the stub's words cancel each other."""
    rows = texts(spark, d).select("id", text_encoder(hashing_encoder)(F.col("text")).alias("v")).withColumn("n", norm("v"))
    return rows.select("id", F.size("v").cast("long").alias("dim"), (F.abs(F.col("n") * F.col("n") - F.col("n")) < 1e-5).alias("is_unit"))


def encode_items(spark: SparkSession, d: str) -> DataFrame:
    rows = encode_batches(texts(spark, d).withColumn("text", F.when(F.col("id") % 9 != 0, F.col("text"))), hashing_encoder, source="text")
    return rows.select("id", F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dim"), "error")


#: Edge of the images that the query makes.
EDGE = 64


def image_preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Images of one colour, which no resampling changes: as the app sees them, and as the offline tools do; every ninth
    has too few bytes."""
    colour = F.expr("substr('0123456789abcdef0f1e2d3c4b5a', int(vec_id % 20) + 1, 6)")
    image = lambda w, h: F.unhex(F.repeat(colour, F.when(F.col("vec_id") % 9 == 8, 7).otherwise(w * h)))
    app, tool = preprocess(target=EDGE), preprocess(normalize=True, target=EDGE, method="bicubic")
    rows = vectors(spark, d).select("vec_id", app(image(75, 65), F.lit(75), F.lit(65)).alias("x"), tool(image(40, 30), F.lit(40), F.lit(30)).alias("y"))
    ends = lambda c: [F.element_at(c, i).cast("double") for i in (1, EDGE * EDGE + EDGE + 7, -1)]
    out = [F.round(v, 4).alias(f"{n}{i}") for n, c in (("app_", "x"), ("tool_", "y")) for i, v in enumerate(ends(c))]  # of single precision
    return rows.select("vec_id", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"), *out)


def half_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("back", from_half(to_half("embedding")))
    return rows.select("vec_id", F.array_join(F.transform("back", lambda x: F.round(x.cast("double") * (1 << 24)).cast("long").cast("string")), ",").alias("back"))


def synthetic_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise(spark, 10, 48, seed=42, normal=True).select("id", norm("pixels").alias("norm")), "norm")


def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores drawn around a mean by relevance, the same each time."""
    u = noise(spark, 200, 1, seed=7, normal=True)
    mean, spread = F.when(F.col("id") % 5 == 0, 0.263).otherwise(0.1), F.when(F.col("id") % 5 == 0, 0.038).otherwise(0.034)
    return rounded(u.select("id", (F.col("id") % 5 == 0).alias("relevant"), (mean + spread * F.element_at("pixels", 1)).alias("score")), "score")


def text_search_stub(spark: SparkSession, d: str) -> DataFrame:
    """Whole path with the stub encoder: texts indexed, queries expanded, encoded, scored, cut and ranked."""
    index = encode_batches(texts(spark, d), hashing_encoder, source="text").select("id", "embedding")
    asked = spark.createDataFrame([(0, "red widget"), (1, " SMALL  ring ")], "query_id long, text string")
    variants = asked.select("query_id", F.explode(X.query_variants("text")).alias("v")).select("query_id", X.normalize_query("v").alias("v")).distinct()
    queries = variants.select("query_id", text_encoder(hashing_encoder)(F.col("v")).alias("embedding"))
    return rounded(S.search(index, queries, key="id"), "score", "best")


QUERIES = {f.__name__: f for f in (query_variants, variant_rows, normalize_query, pretokenize, plural_expand, prompt_templates, pad_token_ids, tool_token_mask, name_match, bpe_encode, query_token_ids, text_encode_stub, encode_items, image_preprocess, half_round_trip, synthetic_noise, relevance_scores, text_search_stub)}

_MESSY = f"t as (select p_partkey as id, p_name as text from part), r as (select id, {messy().replace('chr(9)', 'chr(9)')} as text from t), q as (select id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as c from r)"
_VARIANTS = f"with {_MESSY}, v as (select id, unnest(case when c = '' then [text] else [c, 'a photo of ' || c, 'a picture of ' || c, c || ' photo'] end) as v, unnest(case when c = '' then [0] else [0, 1, 2, 3] end) as i from q), w as (select id, v, min(i) as i from v group by id, v)"
_FORMS = ["cities", "Dresses", "bus", "grass", "cat", " boxes", "es", "photos of dogs"]
_TEMPLATED = ", ".join("'" + t.replace("%s", "' || f || '") + "'" for t in X.TEMPLATES)
_SINGLE = "case when c like '%ies' then regexp_replace(c, 'ies$', 'y') when c like '%es' and length(c) > 3 then regexp_replace(c, 'es$', '') when c like '%s' and c not like '%ss' then regexp_replace(c, 's$', '') else c end"
_IDS = "l as (select p_partkey, list_transform(range(1, p_partkey % 90 + 2), lambda i: (i * 7 + p_partkey) % 50) as ids from part)"

ORACLE_SQL = {
    "query_variants": f"{_VARIANTS} select id, string_agg(v, '{SEP}' order by i) as variants from w group by id",
    "variant_rows": f"{_VARIANTS} select id, row_number() over (partition by id order by i) - 1 as nth, v as variant from w",
    "normalize_query": f"with {_MESSY} select id, case when c = '' then 'a photo' when starts_with(lower(c), 'a photo of ') then lower(c) else 'a photo of ' || lower(c) end as normalized, c = '' as blank from q",
    "pretokenize": f"""with t as (select conv_id, turn, regexp_extract_all(lower(text), '<\\|startoftext\\|>|<\\|endoftext\\|>|''s|''t|''re|''ve|''m|''ll|''d|\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]+') as x from conversations)
select conv_id, turn, len(x) as n, array_to_string(x, '{SEP}') as tokens from t""",
    "plural_expand": f"""with t as (select n_nationkey as id, lower(trim({_FORMS!r}[n_nationkey % 8 + 1])) as c from nation),
f as (select id, c, unnest([c, {_SINGLE}, case when c like '%s' then c else c || 's' end]) as f, unnest([0, 1, 2]) as i from t), g as (select id, c, f, min(i) as i from f group by all)
select id, string_agg(f, '{SEP}' order by i) as forms, any_value(regexp_extract(c, '[^ ]+$')) as head from g group by id""",
    "prompt_templates": f"""with t as (select p_partkey as id, lower(trim(p_name)) as c from part),
f as (select id, unnest([c, {_SINGLE}, case when c like '%s' then c else c || 's' end]) as f, unnest([0, 1, 2]) as i from t), g as (select id, f, min(i) as i from f group by all),
p as (select id, unnest([{_TEMPLATED}]) as p, i * 100 + unnest(range({len(X.TEMPLATES)})) as i from g), h as (select id, p, min(i) as i from p group by all) select id, string_agg(p, '{SEP}' order by i) as prompts from h group by id""",
    "pad_token_ids": f"""with {_IDS}, e as (select p_partkey, least(len(ids) + 2, 77) as n, list_concat([49406], ids[1:75], [49407]) as b from l)
select p_partkey, array_to_string(list_transform(range(1, 78), lambda i: coalesce(b[i], 0)), ',') as input_ids, array_to_string(list_transform(range(1, 78), lambda i: case when i <= n then 1 else 0 end), ',') as mask from e""",
    "tool_token_mask": f"""with {_IDS}, e as (select p_partkey, list_concat([49406], ids, [49407]) as b from l), c as (select p_partkey, case when len(b) > 77 then list_concat(b[1:76], [49407]) else b end as b from e),
z as (select p_partkey, list_transform(range(1, 78), lambda i: coalesce(b[i], 0)) as z from c) select p_partkey, array_to_string(z, ',') as input_ids, array_to_string(list_transform(z, lambda x: case when x <> 0 then 1 else 0 end), ',') as mask from z""",
    "name_match": "with n as (select p_partkey, string_split(upper(p_name) || ' ' || p_type, ' ') as n from part) select p_partkey, coalesce(list_filter(n, lambda x: contains(lower(x), 'ri'))[1], n[1]) as name from n",
    "query_token_ids": f"select query, ids, 77::bigint as padded from (values {', '.join(str(x) for x in GOLDEN)}) t(query, ids)",
    "text_encode_stub": "select p_partkey as id, 64::bigint as dim, true as is_unit from part",
    "encode_items": "select p_partkey as id, case when p_partkey % 9 <> 0 then 64 else 0 end::bigint as dim, case when p_partkey % 9 = 0 then 'no input' end as error from part",
    "image_preprocess": f"""with c as (select vec_id, substr('0123456789abcdef0f1e2d3c4b5a', (vec_id % 20 + 1)::int, 6) as h, vec_id % 9 <> 8 as fits from embeddings),
b as (select vec_id, fits, ('0x' || substr(h, 1, 2))::int / 255.0::double as r, ('0x' || substr(h, 3, 2))::int / 255.0::double as g, ('0x' || substr(h, 5, 2))::int / 255.0::double as b from c)
select vec_id, case when fits then {3 * EDGE * EDGE} else 0 end::bigint as n, {", ".join(f"case when fits then round(({c} - {m}) / {q}, 4) end as {n}{i}" for n, scale in (("app_", ((0.0, 1.0),) * 3), ("tool_", tuple(zip(MEAN, STD, strict=True)))) for i, (c, (m, q)) in enumerate(zip("rgb", scale, strict=True)))} from b""",
    "half_round_trip": """with e as (select vec_id, list_transform(embedding::double[], lambda x: case when x = 0 then 0.0 else round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) end) as v from embeddings)
select vec_id, array_to_string(list_transform(v, lambda x: round(x * 16777216)::bigint), ',') as back from e""",
}
