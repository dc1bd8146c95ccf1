"""Registered queries over the given tables: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm import (
    collocations,
    license_scan,
    metric_search,
    mixing,
    ngram_join,
    packing,
    phrase_dedup,
    pii,
    quality,
    resampling,
    simhash,
    suffix_dedup,
    toxicity,
)
from statweave.llm.frames import read_table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"


@query(
    "op1_ngram_jaccard_join",
    f"""
    with recursive w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') as w from documents
    ), s as (
      select doc_id, unnest(list_distinct(case
        when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w
    ), n as (
      select doc_id, count(*) as n from s group by doc_id
    ), p as (
      select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
    ), l as (
      select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)
    ), e as (
      select x, y from l union all select y, x from l
    ), r as (
      select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x
    )
    select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n using (doc_id)
    join (select x as doc_id, min(y) as component_id from r group by x) m using (doc_id)
    """,
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and shingle count of every document."""
    found = ngram_join.gram_components(read_table(spark, sf_dir, "documents"), n=5, percent=80)
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; strata are languages."""
    found = quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "lang")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, ranks=tokenizer_path(RANKS))


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query(
    "op8_metric_top_k",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
      select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
      from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e)
    ), r as (
      select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
    )
    select query_id, cast(n as integer) as "rank", vec_id, score from r where n <= 5
    """,
)
def metric_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return metric_search.top_inner_products(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op6_license_scan")
def license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


@query("op10_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"),
    )


@query("op4_suffix_dedup")
def suffix_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated 100-byte strings cover."""
    left = suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents"), threshold=100)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query(
    "op5_substring_dedup",
    f"""
    with w as (
      select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents
    ), v as (
      select doc_id, unnest(generate_series(1, len(w) - 19)) as i, w from w where len(w) >= 20
    ), k as (
      select doc_id, i, row_number() over (partition by array_to_string(w[i : i + 19], ' ') order by doc_id, i) as nth from v
    ), g as (
      select distinct doc_id, i + o as i from k, (select unnest(generate_series(0, 19)) as o) where nth > 1
    ), u as (
      select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w
    ), m as (
      select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from u anti join g using (doc_id, i) group by doc_id
    )
    select w.doc_id, len(w) as n_words, len(w) - coalesce(m.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from w left join m using (doc_id)
    """,
)
def substring_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated 20-word windows cover."""
    left = phrase_dedup.remove_repeated_words(read_table(spark, sf_dir, "documents"), window=20)
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op11_phrase_collocations",
    f"""
    with p as (
      select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as p from documents
    ), w as (
      select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p
    ), t as (
      select lang, sum(len(w)) as n from w group by lang
    ), o as (
      select lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i : i + k - 1])) as g
      from w, (select unnest([1, 2, 3]) as k) where len(w) >= k
    ), f as (
      select lang, k, g, count(*) as f from o group by lang, k, g having count(*) >= 10
    ), x as (
      select lang, b, max(f) as f from (
        select lang, g[1:2] as b, f from f where k = 3 union all select lang, g[2:3] as b, f from f where k = 3) group by lang, b
    ), c as (
      select f.lang, f.k, f.g, f.f as a, unnest(generate_series(1, f.k - 1)) as cut from f left join x on x.lang = f.lang and x.b = f.g
      where f.k > 1 and (x.f is null or 100 * x.f < 50 * f.f)
    ), s as (
      select c.*, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score from c
      join f l on l.lang = c.lang and l.g = c.g[1 : cut] join f r on r.lang = c.lang and r.g = c.g[cut + 1 : c.k]
    ), b as (
      select *, row_number() over (partition by lang, g order by score, cut) as nth from s
    ), ranked as (
      select lang, array_to_string(g, ' ') as phrase, a, l, r, score,
        row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(g, ' '))) as "rank" from b where nth = 1
    )
    select lang, "rank", phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked join t using (lang) where "rank" <= 2000
    """,
)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    found = collocations.collocations(read_table(spark, sf_dir, "documents"), longest=3, least=10)
    best = collocations.best_of_language(found, 2000)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op13_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), n=3, distance=2)
    fingerprint = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), F.col("component").alias("component_id"))


_TABLE = """
    crc_table as (
      select list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) order by b) as tab from (select unnest(generate_series(0::bigint, 255)) as b)
    )"""


@query(
    "op12_importance_resampling",
    f"""
    with {_TABLE.strip()}, w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    ), b as (
      select unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
    ), u as (
      select doc_id, unnest(w) as word from w
    ), v as (
      select word, hex(encode(word)) as h from (select word from u union select word from b)
    ), k as (
      select word, xor(4294967295, list_reduce(
        list_concat([4294967295::bigint], list_transform(generate_series(1, len(h), 2), lambda i: ('0x' || h[i : i + 1])::bigint)),
        lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 10000 as bucket from v, crc_table
    ), f as (
      select doc_id, bucket from u join k using (word)
    ), s as (
      select bucket, count(*) as s from f group by bucket
    ), t as (
      select bucket, count(*) as t from b join k using (word) group by bucket
    ), n as (
      select (select coalesce(sum(s), 0) from s) as s, (select coalesce(sum(t), 0) from t) as t
    ), g as (
      select s.bucket, cast(floor(1000 * ln((cast(coalesce(t.t, 0) + 1 as double) * cast(n.s + 10000 as double))
        / (cast(s.s + 1 as double) * cast(n.t + 10000 as double)))) as bigint) as gain from s left join t using (bucket), n
    ), d as (
      select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as weight from f join g using (bucket) group by doc_id
    ), z as (
      select w.doc_id, coalesce(d.n_features, 0) as n_features, coalesce(d.weight, 0) as weight,
        coalesce(d.weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::bigint + 0.5::double) / 4294967296))) as bigint) as score
      from w left join d using (doc_id)
    ), r as (
      select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from z where n_features >= 20
    )
    select z.doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end as "rank" from z left join r using (doc_id)
    """,
)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; a tenth is drawn towards the benchmark texts."""
    found = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
