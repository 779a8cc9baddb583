"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them.

A query applies its operator with production parameters to a whole table and derives the columns it returns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, minhash, quotes, repetition, token_files, toxicity, url_reputation

#: Labels are learned from rows whose id's crc32 leaves another remainder than the held-out one.
TOXIC_FOLDS, TOXIC_HELD = 5, 0
LANGUAGE_FOLDS, LANGUAGE_HELD = 3, 1

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary: $LUMASPARK_VOCABULARY, else the installed public one."""
    found = os.environ.get("LUMASPARK_VOCABULARY")
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Classifier:
    """Learned from labels outside the held-out fold."""
    return toxicity.train(docs, labels.where(langid.split_remainder(F.col("doc_id"), TOXIC_FOLDS) != TOXIC_HELD))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from documents outside the held-out fold."""
    return langid.train(docs.where(langid.split_remainder(F.col("doc_id"), LANGUAGE_FOLDS) != LANGUAGE_HELD))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(langid.split_remainder(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = url_reputation.filter_urls(_table(spark, sf_dir, "pages"), marks, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    held = F.coalesce(langid.split_remainder(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


OP9_SQL = """
with parsed as (
  select page_id,
         case when contains(url, '://') then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
marks as (select doc_id, max(1 - quality) as bad from labels where quality is not null group by doc_id),
hosts as (
  select host, count(*) as n, sum(bad)::bigint as bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as server
  from parsed join marks on page_id = doc_id where host <> '' group by host),
ended as (
  select *, regexp_matches(server, '^[0-9.]+$') or starts_with(server, '[') as numeric,
         case when length(regexp_extract(server, '[^.]*$')) = 2
                   and regexp_extract(server, '([^.]*)[.][^.]*$', 1) in ('ac','asn','co','com','edu','firm','gen','go','gob','gouv','gov','govt','gv','id','ind','info','lg',
                       'ltd','me','mil','ne','net','nhs','nom','or','org','plc','police','sch','school','web')
              then regexp_extract(server, '[^.]*[.][^.]*$') else regexp_extract(server, '[^.]*$') end as ending
  from hosts),
named as (
  select host, n, bad, case when numeric then server else ending end as suffix,
         case when numeric then server
              when contains(ending, '.') then coalesce(nullif(regexp_extract(server, '[^.]*[.][^.]*[.][^.]*$'), ''), server)
              else coalesce(nullif(regexp_extract(server, '[^.]*[.][^.]*$'), ''), server) end as domain
  from ended),
domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from named group by domain, suffix),
suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by suffix),
levels as (
  select 1 as level, n, bad from suffixes union all select 2, n, bad from domains union all select 3, n, bad from named),
sums as (
  select level, sum(n)::double as n, sum(bad)::double as b, count(*) as groups, sum(bad::double * bad / n) as squares from levels group by level),
moments as (
  select level, b / n as rate, (b / n) * (1 - b / n) as chance,
         (squares / n - (b / n) * (b / n)) - (b / n) * (1 - b / n) * groups / n as between_ from sums),
priors as (
  select level, rate, case when between_ > 0 then greatest(1.0, least(1000.0, chance / between_ - 1)) else 1000.0 end as strength from moments),
suffix_means as (
  select suffix, (bad + strength * rate) / (n + strength) as mean from suffixes, priors where level = 1),
domain_means as (
  select d.domain, (d.bad + strength * s.mean) / (d.n + strength) as mean
  from domains d join suffix_means s using (suffix), priors where level = 2),
bounds as (
  select host, m - 1.645 * sqrt(m * (1 - m) / (n + strength + 1)) as bound
  from (select h.host, h.n, strength, (h.bad + strength * d.mean) / (h.n + strength) as m
        from named h join domain_means d using (domain), priors where level = 3)),
ruled as (
  select *,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from parsed)
select page_id, host, path, rule,
       case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
            when bound > 0.5 then 'block' else 'allow' end as verdict
from ruled left join bounds using (host)
"""


# Typed without the possessive forms of the operator: the same matches, as nothing follows a run that it could give back to.
_SQL_RUN = r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
_SQL_DIGITS = r"\p{N}+(?:[.,:/-]\p{N}+)*"
_SQL_MEASURES = rf"({_SQL_DIGITS}) ?({decontam.UNITS})\b"


def _template_sql(source: str, key: str) -> str:
    return f"""select {key}, string_split(t, ' ') as words from (
      select {key}, trim(lower(regexp_replace(replace(t, chr(2), concat(' ', chr(2), ' ')), concat('[^\\p{{L}}\\p{{N}}', {_MARKS}, ']+'), ' ', 'g'))) as t from (
        select {key}, case when regexp_matches(t, '\\p{{N}}') then regexp_replace(regexp_replace(t, '{_SQL_MEASURES}', concat(' ', chr(3), ' ', chr(4), ' '), 'g'),
          '{_SQL_DIGITS}', concat(' ', chr(3), ' '), 'g') else t end as t
        from (select {key}, {_NAMED_SQL} as t from {source} where text is not null and {key} is not null))) where t <> ''"""


#: Without lookbehind a name right after another one is found in a second pass.
_NAMED_SQL = (
    f"regexp_replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}],? ){_SQL_RUN}', concat('\\1', chr(2)), 'g'), "
    f"concat('([\\p{{L}}\\p{{N}}', chr(2), '],? ){_SQL_RUN}'), concat('\\1', chr(2)), 'g')"
)


_MARKS = "chr(2), chr(3), chr(4)"
#: For benchmarks without placeholders, as the supplied ones are: slots are not compared.
OP7_SQL = f"""
with items as ({_template_sql("benchmark", "item_id")}),
sized as (select item_id, words, least(6, len(words)) as size from items where len(words) >= 4),
own as (select * from (select item_id, size, place, words[place : place + size - 1] as cut from (select *, unnest(range(1, len(words) - size + 2)) as place from sized))
  where 2 * len(list_filter(cut, lambda x: x not in ({_MARKS}))) >= size),
keyed as (select item_id, size, place, array_to_string(cut, ' ') as w from own
  union all select item_id, size, place, concat_ws(' ', chr(2), array_to_string(cut[2:], ' ')) from own where place = 1 and size > 1 and cut[1] <> chr(2)),
totals as (select item_id, count(distinct array_to_string(cut, ' ')) as n_windows from own group by item_id),
docs as ({_template_sql("documents", "doc_id")}),
spread as (select doc_id, size, array_to_string(words[place : place + size - 1], ' ') as w
  from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as place from docs, (select distinct size from sized)))
select doc_id, item_id, n_windows, count(distinct place) as n_matched, 0::bigint as n_slots, 0::bigint as n_consistent
from spread join keyed using (size, w) join totals using (item_id) group by doc_id, item_id, n_windows having count(distinct place) >= 0.5 * n_windows
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_minhash_near_dedup,
        op2_html_extraction,
        op3_token_id_output,
        op4_toxicity,
        op5_chat_formatting,
        op6_quality_rules,
        op7_benchmark_decontamination,
        op8_bpe_round_trip,
        op9_url_filters,
        op10_language_id,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can state the whole result: the others are iterative, learned, or depend on a tokenizer."""
    return {"op7_benchmark_decontamination": OP7_SQL, "op9_url_filters": OP9_SQL}
