"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from nodewell.llm import chat, codes, common, decontam, negatives, packing, quality, secrets, sharding, simhash, substring, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    conv = _urn_number
    return read.select(
        conv("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), conv("refers_to").alias("refers_to")
    )


def _urn_number(name: str):
    """warc.number_of in SQL functions: the 64 bits in a record id of ours, two's complement."""
    low = F.regexp_extract(name, "^<urn:uuid:00000000-0000-8000-([0-9a-f]{4}-[0-9a-f]{12})>$", 1)
    hexed = F.translate(low, "-", "")
    unsigned = F.conv(hexed, 16, 10).cast("decimal(20,0)")
    signed = F.when(unsigned >= F.lit(Decimal(2**63)), unsigned - F.lit(Decimal(2**64))).otherwise(unsigned)
    return F.when(low != "", signed).cast("bigint")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *[f"quality.{n}" for n in names])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("cast(-7 as bigint) conv_id", "id turn", "if(id = 0, 'user', 'assistant') role").withColumn("text", F.lit(told))
    return chat.read_conversations(chat.format_conversations(own.unionByName(extra))).withColumnRenamed("conv", "conv_id").drop("fault")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: What an address must contain for its page to go on the list of op9.
LISTED_HOST = "casino|poker|lottery|betting"


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urlfilter.split_url(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOST)).select(urlfilter.canonical_url(F.col("url")).alias("url"))
    return urlfilter.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    out = codes.with_label_error(common.materialise(found, "codes"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_decontaminate, op3_shard, op4_quality, op5_simhash, op6_chat, op7_pack, op8_repeats, op9_urls, op10_secrets, op11_toxicity, op12_negatives, op13_codes)
}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LINE = r"trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'))"
CONTROLS = chat.Template().controls()
ESCAPES = " + ".join([f"(length(text) - length(replace(text, '{c}', ''))) / {len(c)}" for c in CONTROLS] + [r"(length(text) - length(replace(text, '\', '')))"])
FRAMES = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b, _) in chat.Template().turns.items())
HOST = r"case when url like '%://%' then translate(regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
PATH = r"case when url like '%://%' then regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) else '' end"
CANONICAL = r"""regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')
    || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end"""
PARAMETERS = r"list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_.*|ref|gclid|fbclid)(=.*)?$')))"

#: Integer vectors of the embeddings that take part, one row per component.
INTEGERS = """k as (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as d, unnest(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as x from k)"""

#: SQL for the queries that it can express on whole tables. The others need XXH64, a ring in order, alignments, a tokenizer or a model.
ORACLE: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
        select page_id, cast(n as bigint) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(h, cast(1 + 10 * (i // 8) as int), 10) as bigint) >> cast(35 - 5 * (i % 8) as int)) & 31) as int), 1)), '') as payload_digest,
               case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from p""",
    "op4_quality": rf"""
        with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, {WORDS} as w, row_number() over () as r from documents),
        own as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {LINE}), lambda l: l <> '') as n, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as raw from d),
        wins as (select r, unnest(range(1, greatest(len(w) - 6, 1))) as i, w from d),
        twice as (select r, i from (select r, i, count(*) over (partition by r, array_to_string(w[i:i + 7], ' ')) as c from wins) where c > 1),
        rep as (select r, count(distinct p) as n_repeat from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
        votes as (select distinct host, text, unnest(n) as line from own),
        hosts as (select host, count(distinct text) as host_docs from own group by host),
        frequent as (select host, line from (select host, line, count(*) as docs from votes group by all) join hosts using (host) where docs > 20 and docs > 0.05 * host_docs),
        each as (select r, host, unnest(n) as line from own),
        gone as (select r, sum(len(string_split(line, ' '))) as removed from each join frequent using (host, line) group by r),
        s as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                     cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(raw) - len(list_distinct(raw)) as bigint) as n_dup_lines,
                     cast(coalesce(n_repeat, 0) as bigint) as n_repeat_words, cast(coalesce(removed, 0) as bigint) as removed_words
              from own left join rep using (r) left join gone using (r)),
        t as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
        select *, not base_failed and 100 * (n_words - removed_words) >= 50 * n_words as kept from t""",
    "op6_chat": rf"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        o as (select *, lag(role, 1, '') over w as before, lead(role) over w is null as last from c window w as (partition by conv_id order by turn nulls first, role, text))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
               cast({len(chat.Template().begin)} + sum(length(text) + case role {FRAMES} end + {ESCAPES}) as bigint) as formatted_chars,
               bool_and(case before when '' then role in ('system', 'user') when 'user' then role = 'assistant' else role = 'user' end and (not last or role = 'assistant')) as valid
        from o group by conv_id""",
    "op8_repeats": rf"""
        with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
        wins as (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as s from d),
        later as (select doc_id, s from (select doc_id, s, row_number() over (partition by array_to_string(w[s:s + 19], ' ') order by doc_id, s) as k from wins) where k > 1),
        covered as (select distinct doc_id, unnest(range(s, s + 20)) as p from later),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select doc_id, count(covered.p) as n_removed, string_agg(word, ' ' order by p) filter (where covered.p is null) as k from each left join covered using (doc_id, p) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op9_urls": rf"""
        with p as (select page_id, url, {HOST} as host, {PATH} as path, {PARAMETERS} as q from pages),
        c as (select *, {CANONICAL} as canonical from p),
        l as (select distinct canonical from c where regexp_matches(host, '{LISTED_HOST}')),
        r as (select c.page_id, rule, v, row_number() over (partition by c.page_id order by length(rule) desc) as k from c,
                (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rh, rp, v), (select 1), lateral (select rh || rp as rule)
              where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
        select c.page_id, host, path, rule, coalesce(v, case when l.canonical is not null then 'block' else 'allow' end) as verdict, l.canonical is not null as listed
        from c left join r on r.page_id = c.page_id and k = 1 left join l on l.canonical = c.canonical and c.canonical <> ''""",
    "op12_negatives": f"""
        with {INTEGERS},
        t as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from k where label is not null),
        s as (select a.vec_id as a, b.vec_id as b, cast(sum(a.x * b.x) as bigint) as score from c a join c b using (d) where a.vec_id % 100 = 0 group by all),
        m as (select s.*, x.label as al, y.label as bl from s join t x on x.vec_id = a join t y on y.vec_id = b),
        p as (select a, al, b as p, score as ps from (select *, row_number() over (partition by a order by score desc, b) as r from m where al = bl and a <> b) where r <= 5),
        n as (select p.a, p.p, p.ps, m.b, m.score, row_number() over (partition by p.a, p.p order by m.score desc, m.b) as r
              from p join m on m.a = p.a and m.bl <> p.al and 30 * p.ps <= 100 * m.score and 100 * m.score <= 90 * p.ps)
        select a as anchor_id, p as positive_id, cast(r as int) as rank, b as negative_id, ps as positive_score, score as negative_score from n where r <= 10""",
    "op13_codes": """
        with k as materialized (select row_number() over (order by vec_id nulls last) as r, vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c as (select r, unnest(range(len(embedding))) as d, len(embedding) // 16 as w, unnest(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as x from k),
        parts as materialized (select r, d // w as p, d % w as d, x from c),
        b0 as (select p, r - 1 as e, d, x from parts where r <= 64),
        a0 as (select r, p, arg_min(e, (dist, e)) as e, min(dist) as dist from (select x.r, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) as dist from parts x join b0 b using (p, d) group by all) group by r, p),
        b1 as (select b.p, b.e, b.d, coalesce(m.x, b.x) as x from b0 b left join (select p, e, d, cast(floor(sum(x) / count(*)) as bigint) as x from parts join a0 using (r, p) group by p, e, d) m using (p, e, d)),
        a1 as (select r, p, arg_min(e, (dist, e)) as e, min(dist) as dist from (select x.r, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) as dist from parts x join b1 b using (p, d) group by all) group by r, p),
        b2 as (select b.p, b.e, b.d, coalesce(m.x, b.x) as x from b1 b left join (select p, e, d, cast(floor(sum(x) / count(*)) as bigint) as x from parts join a1 using (r, p) group by p, e, d) m using (p, e, d)),
        a2 as (select r, p, arg_min(e, (dist, e)) as e, min(dist) as dist from (select x.r, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) as dist from parts x join b2 b using (p, d) group by all) group by r, p),
        z as (select r, string_agg(format('{:02x}', e), '' order by p) as code, cast(sum(dist) as bigint) as error from a2 group by r),
        h as (select sha256(string_agg(cast(x as varchar), ',' order by p, e, d)) as codebooks_sha256 from b2)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join z using (r), h""",
}
