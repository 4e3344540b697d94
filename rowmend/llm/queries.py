"""Registered queries of the text operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmend import storage
from rowmend.llm import (
    align, factorisation, grammar, katz, lemp, licences, mixing, pieces, refine, secret_scan, simhash, spotsigs, tables, urlrules,
)

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
THRESHOLD = 0.7

# The rules of the url query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def fold(column: str, parts: int):
    """Number of the fold of an id: crc32 of its decimal text."""
    return F.crc32(F.col(column).cast("string")) % parts


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return katz.score_texts(docs, fold("doc_id", 7) != 2).withColumnRenamed("id", "doc_id")


def quality_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> factorisation.Machine:
    labels = tables.documents(spark, sf_dir, "labels").select("doc_id", "quality")
    return factorisation.fit_quality(docs, labels, fold("id", 4) != 2)


def op2_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    scored = factorisation.with_score(docs, quality_machine(spark, docs, sf_dir), "score")
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op3_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refine.exact_groups(tables.documents(spark, sf_dir), all_hashes=True)
    return found.withColumnsRenamed({"id": "doc_id", "text_hash": "text_sha256"})


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(tables.documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))
    return found.withColumnRenamed("id", "doc_id")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all words, at most three epochs of any leaf."""
    found = mixing.mixture(tables.documents(spark, sf_dir), mixing.corpus_levels(), 0.6, 3, seed=11)
    return found.withColumnRenamed("id", "doc_id")


def op6_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "token-files")
    grammar.write_grammars(tables.documents(spark, sf_dir), path, public_tokenizers.path(WORD_MODEL), end_id=1)
    return grammar.read_documents(spark.read.parquet(path)).withColumnRenamed("id", "doc_id")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(tables.documents(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(tables.documents(spark, sf_dir), shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex("print").alias("fingerprint"), "component_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_lemp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.search(tables.documents(spark, sf_dir), tables.documents(spark, sf_dir, "benchmark"), top=50)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(tables.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in (BYTE_MODEL, PIECE_MODEL, BYTE_RANKS)]
    return align.alignment(tables.documents(spark, sf_dir), *paths).withColumnRenamed("id", "doc_id")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_katz, op2_factorisation, op3_refinement, op4_pieces, op5_mixture, op6_grammar, op7_url_rules, op8_simhash,
        op9_licences, op10_spotsigs, op11_lemp, op12_secrets, op13_alignment,
    ]
    return {f.__name__: f for f in found}


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP3_SQL = f"""
with n as (select doc_id, {_NORMAL} as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g on n.norm = g.norm
"""

OP7_SQL = r"""
with p as (
    select page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
    from pages),
r(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (
    select p.page_id, p.host, p.path, r.h || r.p as rule, r.v as verdict,
        row_number() over (partition by p.page_id, p.host, p.path
                           order by length(r.h) + length(r.p) desc, length(r.h) desc, r.v = 'block' desc) as place
    from p left join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where place = 1
"""


def _level_sql(names: list[str], weight: str) -> str:
    """One level of the budget tree: ``b_<n>`` from ``b_<n-1>``."""
    depth, path, parent = len(names), ", ".join(names), ", ".join(names[:-1])
    window = f"partition by {parent}" if parent else ""
    join = f"join b{depth - 1} using ({parent})" if parent else f"cross join b{depth - 1}"
    return f"""
c{depth} as (select {path}, sum(cap) as cap, cast({weight} as double) as weight from leaves group by {path}),
f{depth} as (
    select *, (total - coalesce(sum(cap) over ({window} order by cap / weight, {names[-1]}
                                               rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over ({window} order by cap / weight, {names[-1]}
                               rows between current row and unbounded following) as level
    from c{depth} {join} where weight > 0),
b{depth} as (
    select {path}, case when cap / weight <= level then cap else least(cap, greatest(0.0,
        (total - coalesce(sum(case when cap / weight <= level then cap end) over ({window}), 0))
        / sum(case when cap / weight > level then weight end) over ({window}) * weight)) end as total
    from f{depth})"""


_WORDS = r"""case when regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') = '' then 0
    else len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) end"""


def mixture_sql(table: str, share: float, epochs: int, seed: int) -> str:
    """CTEs ending in ``mixed``: what ``mixing.mixture`` gives over ``table`` with the production tree."""
    domain = "case domain when 'd0' then 3 when 'd1' then 2 when 'd2' then 2 else 1 end"
    lang = "case lang when 'en' then 6 when 'fr' then 2 when 'de' then 2 when 'es' then 2 else 1 end"
    return f"""
mrows as (
    select doc_id, cast({_WORDS} as bigint) as n_tokens,
        coalesce('d' || cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3 as varchar), 'none') as domain,
        coalesce(lang, 'none') as lang, coalesce(source, 'none') as source
    from {table}),
leaves as (select domain, lang, source, cast(sum(n_tokens) as double) as tokens,
                  cast(sum(n_tokens) as double) * {epochs} as cap from mrows group by all),
b0 as (select floor(sum(tokens) * cast({share} as double)) as total from leaves),
{_level_sql(['domain'], domain)},
{_level_sql(['domain', 'lang'], lang)},
{_level_sql(['domain', 'lang', 'source'], '1')},
plan as (
    select domain, lang, source, tokens, coalesce(total, 0.0) as budget,
        cast(case when tokens > 0 then floor(coalesce(total, 0.0) / tokens) else 0 end as bigint) as epochs
    from leaves left join b3 using (domain, lang, source)),
spots as (
    select mrows.*, epochs, budget - epochs * tokens as rest,
        md5('{seed}-' || cast(epochs as varchar) || '-' || coalesce(cast(doc_id as varchar), 'none')) as spot
    from mrows join plan using (domain, lang, source)),
starts as (
    select *, sum(n_tokens) over (partition by domain, lang, source order by spot
                                  range between unbounded preceding and current row)
        - sum(n_tokens) over (partition by domain, lang, source, spot) as start
    from spots),
mixed as (
    select doc_id, domain, lang, source, n_tokens, epochs, (start < rest and n_tokens > 0) as in_prefix,
        epochs + cast(start < rest and n_tokens > 0 as bigint) as copies
    from starts)"""


OP5_SQL = f"with {mixture_sql('documents', 0.6, 3, 11)} select * from mixed"


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
with d as (select doc_id, {_TERMS.format('text')} as terms from documents),
size as (select cast(count(*) filter (len(terms) > 0) as bigint) as big_n, cast(sum(len(terms)) as bigint) as big_l from d),
word as (select doc_id, unnest(terms) as term from d),
tf as (select doc_id, term, count(*) as tf from word group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
wanted as (select distinct item_id, unnest({_TERMS.format('text')}) as term from benchmark),
weighted as (
    select item_id, term, cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
    from wanted join df using (term) cross join size),
measure as (select doc_id, 100 - 50 + ((50 * len(terms) * big_n) // big_l) as m from d cross join size where len(terms) > 0),
scored as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
    from weighted join tf using (term) join measure using (doc_id) group by item_id, doc_id),
ranked as (
    select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank
    from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


def all_oracles() -> dict[str, str]:
    return {"op3_refinement": OP3_SQL, "op5_mixture": OP5_SQL, "op7_url_rules": OP7_SQL, "op11_lemp": OP11_SQL}
