"""The registered queries opN_<name>: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import bpe, filter_audit, jpeg_media, langid, lexical, license_scan, line_dedup, mixing, ngram_join, quality, secrets, topk, toxicity
from veilgrid.llm.common import in_remainder, labelled_sample, read_table


#: Toxicity scores from here on count as toxic.
TOXIC_FROM = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Labelled rows that a model learns from.
LEARNED_ROWS = 20_000


def labelled(spark: SparkSession, sf_dir: str, label: str, held: Column) -> DataFrame:
    """Documents with ``label__``, of labels that are not held out."""
    return labelled_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where(~held), label, LEARNED_ROWS)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_remainder(F.col("doc_id"), 4, 2)
    model = toxicity.fit(labelled(spark, sf_dir, "toxic", held), F.col("label__"), F.col("doc_id"))
    columns = [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")]
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), model, columns, "doc_id bigint, held_out boolean")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "clauses")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = in_remainder(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held), F.col("lang"))
    columns = [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")]
    return langid.identify(docs, model, columns, "doc_id bigint, held_out boolean")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.store(read_table(spark, sf_dir, "documents"), with_media=False)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read_table(spark, sf_dir, "documents"), words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, every_row=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_remainder(F.col("doc_id"), 3, 1)
    model = quality.fit(labelled(spark, sf_dir, "quality", held), F.col("label__"))
    columns = [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")]
    scored = quality.score(read_table(spark, sf_dir, "documents"), model, columns, "doc_id bigint, held_out boolean")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.delete_later_copies(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "kept_lines", "deleted_lines", "deleted_runs")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"), [F.col("doc_id")], "doc_id bigint")
    base = found.select("*", F.filter("found", lambda f: f["base"]).alias("places"))
    starts = F.transform("places", lambda f: f["first_word"])
    return base.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        license_scan.label_text(F.col("places")).alias("base_labels"), license_scan.label_text(F.col("found")).alias("labels"), license_scan.score(F.col("found")).alias("score"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_jpeg": op5_jpeg,
    "op6_ngram_join": op6_ngram_join,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_lexical_search": op13_lexical_search,
}
#: What learns, samples or merges has no SQL; the others do.
ORACLES: dict[str, str] = {
    "op6_ngram_join": r"""with recursive words as materialized (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        shingles as materialized (select distinct doc_id, array_to_string(w[i:i+3], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w)-3, 1)+1)) i from words where len(w) > 0)),
        sizes as materialized (select doc_id, count(*) n from shingles group by 1),
        shared as (select a.doc_id u, b.doc_id v, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        links as materialized (select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100*c >= 85*(x.n+y.n-c)),
        ways as materialized (select u, v from links union all select v, u from links),
        reach as (select doc_id, doc_id r from documents union select reach.doc_id, ways.v from reach join ways on ways.u = reach.r)
        select d.doc_id, coalesce(n, 0) n_shingles, component_id from documents d left join sizes using (doc_id) join (select doc_id, min(r) component_id from reach group by 1) using (doc_id)""",
    "op10_line_dedup": r"""with cut as materialized (select doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1)-1 k from documents),
        told as materialized (select doc_id, k, line, trim(line, E' \t\r\f\x0b') bare, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) n from cut),
        worded as materialized (select *, row_number() over w j, sum(n) over w total from told where n > 0 window w as (partition by doc_id order by k)),
        ahead as (select a.doc_id, a.j first, min(b.j) last from worded a join worded b on a.doc_id = b.doc_id and b.j between a.j and a.j+49 and b.total-a.total+a.n >= 50 group by 1, 2),
        back as (select b.doc_id, max(a.j) first, b.j last from worded a join worded b on a.doc_id = b.doc_id and a.j between b.j-49 and b.j and b.total-a.total+a.n >= 50 group by 1, 3),
        runs as materialized (select r.doc_id, r.first, r.last, min(w.k) low, max(w.k) high, string_agg(bare, chr(10) order by j) content from (select * from ahead union select * from back) r join worded w on w.doc_id = r.doc_id and w.j between r.first and r.last group by 1, 2, 3),
        later as (select doc_id, low, high from (select *, row_number() over (partition by content order by doc_id, first) place from runs) where place > 1),
        marked as materialized (select t.*, exists (select 1 from later l where l.doc_id = t.doc_id and t.k between l.low and l.high) dead from told t),
        stretches as (select doc_id, string_agg(low || ':' || high, ',' order by low) runs from (select doc_id, min(k) low, max(k) high from (select doc_id, k, k - row_number() over (partition by doc_id order by k) g from marked where dead) group by doc_id, g) group by 1),
        done as (select doc_id, string_agg(line, chr(10) order by k) filter (not dead) as text, count(*) filter (n > 0 and not dead) kept, count(*) filter (n > 0 and dead) gone from marked group by 1)
        select d.doc_id, case when gone > 0 then coalesce(done.text, '') else d.text end as text, cast(coalesce(kept, 0) as int) kept_lines, cast(coalesce(gone, 0) as int) deleted_lines, coalesce(runs, '') deleted_runs
        from documents d left join done using (doc_id) left join stretches using (doc_id)""",
    "op7_topk": """with whole as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as hugeint)) v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select q.vec_id query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]*p[2])), 0) score from whole q join whole c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from scored)
        select query_id, cast(k as int) as rank, vec_id, cast(greatest(-9223372036854775808, least(9223372036854775807, score)) as bigint) score from ranked where k <= 5""",
    "op11_filter_audit": r"""with docs as materialized (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        told as materialized (select doc_id, part, [len(w) < 200, 100*len(list_distinct(w)) < 50*len(w), 100*(len(t)-len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2*len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] fails from docs),
        marks as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels where doc_id is not null group by 1),
        kinds as materialized (select part, fails, coalesce(good, false) good, coalesce(toxic, false) toxic, count(*) n from told left join marks using (doc_id) group by all),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
        orders as (select a.c || b.c || d.c || e.c || f.c o from letters a, letters b, letters d, letters e, letters f where len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
        runs as materialized (select part, o, s, strpos('ABCDE', o[s]) f, good, toxic, n, fails[strpos('ABCDE', o[s])] own, list_bool_or(list_transform(range(1, s), lambda i: fails[strpos('ABCDE', o[i])])) seen, len(list_filter(fails, lambda x: x)) many from kinds, orders, (select unnest([1, 2, 3, 4, 5]) s)),
        counted as materialized (select part, o, s, f, sum(n) filter (not own and not coalesce(seen, false)) kept, sum(n) filter (own and not coalesce(seen, false)) removed, sum(n) filter (own and seen) redundant, sum(n) filter (own and many = 1) unique_fails, sum(n) filter (own and good and not coalesce(seen, false)) good_lost, sum(n) filter (own and toxic and not coalesce(seen, false)) toxic_lost from runs group by all)
        select part, o filter_order, cast(s as int) step, cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(removed, 0) as bigint) removed, cast(coalesce(redundant, 0) as bigint) redundant, cast(coalesce(unique_fails, 0) as bigint) unique_fails, cast(coalesce(good_lost, 0) as bigint) good_lost, cast(coalesce(toxic_lost, 0) as bigint) toxic_lost, cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) shapley from counted""",
    "op13_lexical_search": r"""with terms as materialized (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents where text is not null),
        asked as materialized (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where item_id is not null),
        whole as (select count(*) n_all, sum(len(w)) l_all from terms where len(w) > 0),
        spread as (select r, doc_id, len(w) n, unnest(w) term from terms),
        held as materialized (select r, doc_id, n, term, count(*) tf from spread where term in (select term from asked) group by all),
        weighed as materialized (select term, cast(floor(1000*ln((2*n_all+2)::double/(2*count(*)+1)::double)) as bigint) w from held, whole group by term, n_all),
        gains as (select item_id, r, doc_id, w*((1000000000*tf)//(1000*tf+20*(100-50+cast((50*n*n_all)//l_all as bigint)))) g from held join weighed using (term) join asked using (term), whole),
        scored as (select item_id, r, doc_id, cast(sum(g) as bigint) score from gains group by all having sum(g) > 0),
        ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) k from scored)
        select item_id, cast(k as int) as rank, doc_id, score from ranked where k <= 50""",
}
