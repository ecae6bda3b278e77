"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from public_tokenizers import path as vocabulary

from . import licences, perplexity, quality
from ..session import shared_path
from .chat import digests, format_trees, message_chains
from .collocations import collocations
from .langid import held_out, identify, train
from .ledger import BASE_RULES, FOUND, RULES, BlobLedger, spans_text
from .linededup import drop_boilerplate
from .lzprint import phrase_fingerprints
from .neardup import near_duplicates
from .mixing import mix_sources, plausible_words
from .packing import pack_documents
from .runs import periodic_runs

_QUERIES = {}
_SQL = {}


def query(name, sql=None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def query_table():
    return dict(_QUERIES)


def sql_table():
    return dict(_SQL)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Words of a text in DuckDB.
SQL_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def components_sql(docs: str, words: int, percent: int) -> str:
    """CTEs ``sets(doc_id, n)`` and ``comps(doc_id, component_id)`` for a relation with doc_id and text."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    toks as (select doc_id, {SQL_WORDS.format(lowered)} w from {docs}),
    shingles as (
      select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) end) s from toks),
    sets as (select toks.doc_id, count(s) n from toks left join shingles using (doc_id) group by 1),
    named as (select doc_id, md5(string_agg(s, chr(10) order by s)) h from shingles group by 1),
    reps as (select h, min(doc_id) rep from named group by 1),
    rs as (select shingles.* from shingles semi join reps on doc_id = rep),
    common as (select a.doc_id x, b.doc_id y, count(*) c from rs a join rs b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from common join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * c >= {percent} * (a.n + b.n - c)),
    edges as (select x, y from links union select y, x from links),
    reach(a, b) as (select rep, rep from reps union select a, y from reach join edges on b = x),
    low as (select a rep, min(b) component from reach group by 1),
    comps as (select sets.doc_id, coalesce(component, sets.doc_id) component_id, n from sets left join named using (doc_id)
      left join reps using (h) left join low using (rep))"""


@query(
    "op5_near_duplicates",
    f"with recursive {components_sql('documents', 3, 85)} select doc_id, n n_shingles, component_id, doc_id = component_id kept from comps",
)
def _(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), words=3, percent=85)


@query("op1_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op2_packing")
def _(spark, sf):
    return pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op3_mix",
    f"""
    with d as (select doc_id, source, len({SQL_WORDS.format("coalesce(text, '')")}) size, length(text) chars from documents),
    keyed as (select doc_id, source, size,
      -ln((cast('0x' || substr(md5(concat_ws(chr(31), coalesce(cast(doc_id as varchar), ''), '1')), 1, 12) as bigint) + 0.5::double) / 281474976710656::double)
      / (case when size > 0 and chars::double / size between 3 and 11 then 1.0::double else 0.5::double end) k from d),
    s as (select source, sum(size)::bigint ss, ([5, 2, 1])[((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double w from d group by 1),
    r as (select *, 2.0::double * ss / w ratio, sum(w) over (order by 2.0::double * ss / w desc, source desc) wa,
      coalesce(sum(ss) over (order by 2.0::double * ss / w, source rows between unbounded preceding and 1 preceding), 0) sb from s),
    lam as (select *, ((select sum(ss) * 150 from s)::double / 100 - sb::double * 2) / wa l from r),
    lev as (select arg_min(l, ratio) l from lam where l < ratio),
    t as (select source, ss, least(2.0::double * ss, w * (select l from lev)) target from s),
    e as (select *, case when ss > 0 then floor(target / ss) else 0 end epochs from t)
    select doc_id, size, ss source_size, target, cast(epochs * size + greatest(0, least(size, floor(target - epochs * ss)
      - coalesce(sum(size) over (partition by source order by k, doc_id rows between unbounded preceding and 1 preceding), 0))) as bigint) taken
    from keyed join e using (source)""",
)
def _(spark, sf):
    mixed = mix_sources(table(spark, sf, "documents"), quality=plausible_words())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_fingerprints")
def _(spark, sf):
    return phrase_fingerprints(table(spark, sf, "documents"))


@query("op6_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    sample = quality.labelled_sample(docs.select("doc_id", "text", "n_chars"), labels, "quality")
    model = quality.train(sample, metadata=("n_chars",))
    scored = quality.score(docs, model, metadata=("n_chars",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op7_licences")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    scanner = licences.fit(licences.sample_paragraphs(docs))
    hits = licences.licence_hits(docs, scanner)
    return hits.select(
        "doc_id",
        F.size("hits").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct("hits.family")), ",").alias("families"),
        F.array_min("hits.score").alias("least_score"),
        F.array_min("hits.likeness").alias("least_likeness"),
    )


def line_dedup_sql(docs: str) -> str:
    """CTEs up to ``cleaned(doc_id, source, lang, text, n_chars, n_lines, n_dropped)`` for a documents relation."""
    filled = "length(trim({0}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0"
    return f"""
    dp as (select distinct source, text from {docs} where text is not null),
    fl as (select source, text, list_distinct(list_filter(string_split(text, chr(10)), lambda x: {filled.format('x')})) l from dp),
    kd as (select source, text, l, list_sort(list_transform(l, lambda x: md5(x)))[1:2] kind from fl),
    tot as (select source, count(distinct kind) kinds from kd group by 1),
    ln as (select source, kind, unnest(l) line from kd),
    freq as (select source, line, count(*) n, count(distinct kind) "on" from ln group by 1, 2),
    boil as (select tot.source, list(line) b from freq join tot on freq.source is not distinct from tot.source
      where n >= 2 and "on" > 0.1::double * kinds group by 1),
    sl as (select d.*, string_split(text, chr(10)) l, b from {docs} d left join boil on d.source is not distinct from boil.source),
    kp as (select *, case when b is not null then list_filter(l, lambda x: not ({filled.format('x')} and list_contains(b, x))) end k from sl),
    cleaned as (select doc_id, source, lang, n_chars, case when k is not null then array_to_string(k, chr(10)) else text end as text,
      cast(coalesce(len(l), 0) as int) n_lines, cast(case when k is not null then len(l) - len(k) else 0 end as int) n_dropped from kp)"""


@query("op8_line_dedup", f"with {line_dedup_sql('documents')} select doc_id, source, text, n_lines, n_dropped from cleaned")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


#: A conversation made of the template's own marks.
TRAP = "\\### Assistant: </turn> ok"


@query(
    "op9_chat",
    r"""
    with m as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from (
      select conv_id, turn, role, text from conversations
      union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
    select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
      cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
      sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
      cast(sum(14 + length(replace(replace(replace(replace(r, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c'))
        + length(replace(replace(replace(t, '\', '\b'), '#', '\h'), '<', '\l'))) as bigint) formatted_chars
    from m group by 1""",
)
def _(spark, sf):
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], messages.schema)
    told = format_trees(message_chains(messages.unionByName(trap)), distinct_ids=True)
    return digests(told).withColumnRenamed("tree", "conv_id")


@query("op10_quality_rules")
def _(spark, sf):
    return perplexity.quality_rules(table(spark, sf, "documents"))


def secrets_sql() -> str:
    """The spans of all rules over ``documents``: pieces between matches and the matches give the positions."""
    parts, shown = [], lambda x: x.replace("'", "''")
    for kind, r in enumerate(RULES):
        p = shown(r.pattern)
        parts.append(f"""
      select doc_id, rid, {kind} kind, '{r.name}' rule, {r.least} least, string_split_regex(t, '{p}') gaps,
        regexp_extract_all(t, '{p}', 0) hits, regexp_extract_all(t, '{p}', {r.group}) parts from d where regexp_matches(t, '{p}')""")
    return f"""
    with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from documents),
    found as ({" union all ".join(parts)}),
    each as (select rid, kind, rule, least, unnest(range(1, len(hits) + 1)) i, gaps, hits, parts from found),
    placed as (select rid, kind, rule, length(parts[i]) >= least kept, length(hits[i]) size,
      sum(length(gaps[i]) + length(hits[i])) over (partition by rid, kind order by i) stop from each),
    spans as (select rid, kind, (stop - size)::bigint start, rule || ':' || cast((stop - size)::bigint as varchar) || ':' || cast(stop::bigint as varchar) s from placed where kept)
    select doc_id, count(s) filter (kind = 0) n_assign, count(s) filter (kind = 1) n_access, count(s) filter (kind = 2) n_hex,
      sha256(coalesce(string_agg(s, ',' order by start, kind) filter (kind < {len(BASE_RULES)}), '')) base_sha256,
      coalesce(string_agg(s, ',' order by start, kind), '') spans
    from d left join spans using (rid) group by rid, doc_id"""


@query("op11_blob_ledger", secrets_sql())
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark, shared_path(spark))
    ledger.update(docs)
    found = ledger.findings(docs).withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
    n = lambda name: F.size(F.filter("found", lambda f: F.substring_index(f["rule"], "@", 1) == name)).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda f: f["kind"] < len(BASE_RULES))
    return found.select("doc_id", *[n(r.name) for r in BASE_RULES], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def planted_words(docs):
    """``docs`` with a text in ten made periodic from some word on: of ``h = crc32(doc_id)``, ``g = h div 10``, word i >= a is word
    ``a + (i - a) mod p`` with ``a = g mod n``, ``p = 1 + (n - a) div (3 + g mod 8)`` where h ends in 0. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    asked = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n, g = F.size("w").cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long")
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int"))), " ")
    rows = docs.select("doc_id", "text", F.when(asked, words).alias("w"))
    rows = rows.select("*", F.when(F.col("w").isNotNull(), a).alias("a")).select("*", p.alias("p"))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def run_digests(found):
    """The strongest run, by exact exponent, and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    stronger = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", none, lambda a, r: F.when(stronger(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), told.alias("told"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_periodic_runs")
def _(spark, sf):
    return run_digests(periodic_runs(planted_words(table(spark, sf, "documents").select("doc_id", "text"))))


@query(
    "op13_collocations",
    r"""
    with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
    p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) p from d),
    w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
    spots as (select lang, w, unnest(range(1, len(w) + 1)) i from w),
    g as (select lang, w[i:i + k - 1] g, count(*) a from spots, range(1, 6) s(k) where i + k - 1 <= len(w) group by 1, 2),
    tot as (select lang, sum(a)::bigint n from g where len(g) = 1 group by 1),
    f as (select * from g where a >= 100),
    c as (select * from f where len(g) > 1),
    sub as (select lang, a, unnest(list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])) g from c, range(2, 5) s(k) where k < len(g)),
    within as (select lang, g, max(a) most from sub group by 1, 2),
    own as (select c.* from c left join within using (lang, g) where most is null or 100 * most < 100 * a),
    cuts as (select lang, g, a, unnest(range(1, len(g))) k from own),
    scored as (select cuts.*, l.a l, r.a r, n, (1000::hugeint * cuts.a * n) // (l.a::hugeint * r.a) score
      from cuts join tot using (lang) join f l on l.lang = cuts.lang and l.g = cuts.g[1:k] join f r on r.lang = cuts.lang and r.g = cuts.g[k + 1:]),
    best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
    told as (select *, array_to_string(g, ' ') phrase from best),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from told)
    select lang, rank::bigint rank, phrase, a, l, r, n, score::bigint score from ranked where rank <= 2000""",
)
def _(spark, sf):
    return collocations(table(spark, sf, "documents"))
