"""The queries op1_ to op13_ and pipeline, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, audit, mixing, neardup, packing, passages, quality, secretscan, simhash, suffixes, tokencount, urlrules, warc
from .common import table


#: The rules of op9 (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_rows(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokencount.TOKENIZER))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scanned(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(host, path, verdict)")
    return urlrules.judged(table(spark, sf_dir, "pages"), rules)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_click_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.click_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_entropy_mixing, op2_quality_rules, op3_minhash_near_dedup, op4_token_counts, op5_warc_archive, op6_simhash,
    op7_secret_scan, op8_best_fit_packing, op9_url_rules, op10_paragraph_dedup, op11_filter_audit, op12_suffix_dedup, op13_click_orders, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# DuckDB SQL of the queries that SQL can express: exact rules, exact links, digests and the longest rule.

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _op2_sql() -> str:
    grams = sorted({*quality.COVERAGE, quality.WINDOW})
    parts = [
        f"d as (select *, row_number() over () as r, {_WORDS} as w from documents)",
        "words as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d)",
    ]
    for n in grams:
        parts += [
            f"win{n} as (select r, i, array_to_string(w[i:i + {n - 1}], ' ') as g from (select r, w, unnest(range(1, len(w) - {n - 2})) as i from d where len(w) >= {n}))",
            f"dup{n} as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win{n}) where c > 1)",
            f"cov{n} as (select distinct r, unnest(range(i, i + {n})) as i from dup{n})",
            f"sum{n} as (select r, count(*) as words_, sum(length(word)) as chars from cov{n} join words using (r, i) group by r)",
        ]
    symbols = "length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))"
    parts += [
        "line as (select r, unnest(range(len(l))) as k, unnest(l) as line from (select r, string_split(coalesce(text, ''), chr(10)) as l from d))",
        "seen as (select r, line, row_number() over (partition by r, line order by k) as c from line where regexp_matches(line, '[^\\x20\\x09-\\x0D]'))",
        "lines as (select r, count(*) as n, sum(length(line)) as chars from seen where c > 1 group by r)",
    ]
    coalesced = ", ".join(f"cast(coalesce(sum{n}.chars, 0) as bigint) as chars_{n}" for n in quality.COVERAGE)
    joins = " ".join(f"left join sum{n} on sum{n}.r = d.r" for n in grams)
    base = f"""select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, {symbols} as n_symbols,
        coalesce(lines.n, 0) as n_dup_lines, coalesce(sum{quality.WINDOW}.words_, 0) as n_repeat_words, cast(coalesce(lines.chars, 0) as bigint) as char_lines, {coalesced}, length(coalesce(text, '')) as n_chars_
        from d left join lines on lines.r = d.r {joins}"""
    covered = " and ".join(f"100 * chars_{n} <= {most} * word_chars" for n, most in quality.COVERAGE.items())
    failed = f"(n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)"
    kept = f"not {failed} and 100 * char_lines <= {quality.LINE_COVERAGE} * n_chars_ and {covered}"
    return f"with {', '.join(parts)} select * exclude (n_chars_), {failed} as base_failed, {kept} as kept from ({base})"


def _op3_sql() -> str:
    lowered = f"translate(coalesce(text, ''), '{urlrules._UPPER}', '{urlrules._LOWER}')"
    words = _WORDS.replace("coalesce(text, '')", lowered)
    return f"""with recursive d as (select doc_id, {words} as w from documents),
        s as (select doc_id, case when len(w) > 1 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end as g from d),
        x as (select doc_id, len(g) as n, unnest(g) as g from s),
        e as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id and 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
              group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r as (select doc_id as node, doc_id as root from d union select e.b, r.root from r join e on e.a = r.node),
        c as (select node, min(root) as component_id from r group by node)
        select doc_id, cast(len(g) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c on c.node = s.doc_id"""


def _op5_sql() -> str:
    letters = [
        f"substr('{warc.BASE32}', cast((v // {1 << shift}) % 32 as bigint) + 1, 1)".replace("v", f"cast('0x' || substr(hexed, {5 * k + 1}, 5) as bigint)")
        for k in range(8) for shift in (15, 10, 5, 0)
    ]
    return f"""select page_id, octet_length(encode(html)) as payload_bytes, {' || '.join(letters)} as payload_digest,
        case when page_id = owner then 'response' else 'revisit' end as record_type, case when page_id <> owner then owner end as refers_to
        from (select page_id, html, sha1(html) as hexed, max(page_id) over (partition by html) as owner from (select page_id, coalesce(html, '') as html from pages))"""


def _op9_sql() -> str:
    rules = ", ".join(map(str, RULES))
    return f"""with u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urlrules._UPPER}', '{urlrules._LOWER}') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
        rules(h, p, v) as (values {rules}),
        fit as (select u.*, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as k
            from u left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
        select page_id, host, path, rule, coalesce(v, '{urlrules.DEFAULT}') as verdict from fit where k = 1"""


def _op11_sql() -> str:
    letters = "(values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    orders = " || ".join(f"f{i}.l" for i in range(5))
    tables = ", ".join(f"{letters} f{i}(l, b)" for i in range(5))
    apart = " and ".join(f"f{i}.b <> f{j}.b" for j in range(5) for i in range(j))
    steps = " union all ".join(f"select {orders} as filter_order, {i + 1} as step, f{i}.b as own, {' + '.join([f'f{j}.b' for j in range(i)] or ['0'])} as earlier from {tables} where {apart}" for i in range(5))
    text = "coalesce(text, '')"
    return f"""with d as (select doc_id, coalesce(lang, '') as part, {text} as t, {_WORDS} as w, coalesce(min(doc_id) over (partition by {text}) < doc_id, false) as e from documents),
        x as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
            (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
            + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when e then 16 else 0 end) as mask
            from d left join x using (doc_id)),
        c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
        s as ({steps}),
        r as (select part, filter_order, step, own,
            cast(sum(case when mask & (earlier | own) = 0 then n else 0 end) as bigint) as kept,
            cast(sum(case when mask & earlier = 0 and mask & own <> 0 then n else 0 end) as bigint) as removed,
            cast(sum(case when mask & earlier <> 0 and mask & own <> 0 then n else 0 end) as bigint) as redundant,
            cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
            cast(sum(case when mask & earlier = 0 and mask & own <> 0 then good else 0 end) as bigint) as good_lost,
            cast(sum(case when mask & earlier = 0 and mask & own <> 0 then toxic else 0 end) as bigint) as toxic_lost
            from c cross join s group by part, filter_order, step, own)
        select part, filter_order, cast(step as integer) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r"""


def _op13_sql() -> str:
    # The check sum of zlib, bit by bit over the digits.
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = lambda c: f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast({c} as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda c, b: {bits}), 4294967295)"
    used = lambda t, h: f"case when {h} % 2 = 1 then epoch_us({t}) // {asof.FLOOR_US} * {asof.FLOOR_US} else epoch_us({t}) end"
    return f"""with c as (select click_id, client_id, {used('ts', 'h')} as ts_us from (select distinct click_id, client_id, ts, {crc('click_id')} as h from clicks)),
        s as (select sale_id, client_id, {used('sold_at', 'h')} as sold_us, cast(floor(100 * total + 0.5) as bigint) as total_cents, h from (select *, {crc('sale_id')} as h from sales)),
        o as (select sale_id, client_id, sold_us, total_cents from s union all select -1 - sale_id, client_id, sold_us, total_cents from s where h % 3 <> 0),
        k as (select * from (select *, row_number() over (partition by client_id, sold_us order by total_cents desc nulls last, sale_id desc) as place, count(*) over (partition by client_id, sold_us) as n_tied
            from o where client_id is not null and sold_us is not null) where place = 1),
        j as (select c.*, k.sold_us, k.sale_id, k.total_cents, k.n_tied from c asof left join k on c.client_id = k.client_id and c.ts_us >= k.sold_us)
        select click_id, client_id, ts_us, case when ok then sale_id end as sale_id, case when ok then ts_us - sold_us end as lag_us, case when ok then total_cents end as total_cents, case when ok then n_tied else 0 end as n_tied
        from (select *, coalesce(ts_us - sold_us <= {asof.TOLERANCE_US}, false) as ok from j)"""


def oracle_sql() -> dict[str, str]:
    new = {"op11_filter_audit": _op11_sql(), "op13_click_orders": _op13_sql()}
    return new | {"op2_quality_rules": _op2_sql(), "op3_minhash_near_dedup": _op3_sql(), "op5_warc_archive": _op5_sql(), "op9_url_rules": _op9_sql()}
