"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import chat_format, decontam, hmm_lm, jaccard_join, langid, license_scan, lsh_forest, mixing, pstable, secret_scan, spelling, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a document is source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return lsh_forest.search(rows, rows.filter("id % 50 = 0"), k=5)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.examples(turns.unionByName(more)))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm_lm.score(docs.withColumn("held", langid.fold(docs, 5) == 1))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.draw(docs, mixing.make_plan(spark, docs))
    taken = (F.col("size") * F.size("shards")).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.fold(docs, 5) == 0
    model = toxicity.fit(toxicity.training_rows(docs.filter(~held), table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(langid.fold(docs, 4) != 2))
    return langid.predict(docs.select("doc_id", (langid.fold(docs, 4) == 2).alias("held_out"), "text"), model).drop("text")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits is null here; ``deviation_exact`` holds it."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    long = F.col("deviation").try_cast("bigint").alias("deviation")
    return found.select(F.col("id").alias("vec_id"), "component", "n", long, "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variant_groups(spelling.drop_letters(found).select("word"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return pstable.near_vectors(rows).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_ngram_jaccard_join,
        op3_nearest_neighbours,
        op4_chat_formatting,
        op5_language_model,
        op6_mixing_sources,
        op7_secret_scans,
        op8_toxicity,
        op9_language_id,
        op10_benchmark_decontamination,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_embedding_near_dedup,
    )
}
#: Escapes in x: one for each backslash and each control string.
_ESCAPES = r"""cast(list_sum(list_transform(['\', '<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'], lambda c: (length(x) - length(replace(x, c, ''))) // length(c))) as bigint)"""
_FRAME = len(chat_format.TURN + chat_format.TEXT + chat_format.END)

#: The other operators cannot be expressed in SQL; tests compare them with brute force, round trips or held-out accuracy.
ORACLE: dict[str, str] = {
    "op4_chat_formatting": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, role || text as x from t),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n, length(x) + {_ESCAPES} + {_FRAME} as chars from e),
c as (select *, sum(chars) over (partition by conv_id order by i) as upto, role = 'assistant' or i = n as target from o),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by i) as turns, coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '') as loss,
  cast(sum(upto) filter (where target) as bigint) as formatted_chars, count(*) filter (where target) as n_examples from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_examples from g""",
    "op12_spelling_variants": r"""
with table256 as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as t),
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents),
lower_runs as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k from runs group by all),
codes as (select *, list_transform(range(1, length(id || ':' || run) + 1), lambda i: cast(unicode(substr(id || ':' || run, i, 1)) as bigint)) as c from lower_runs),
bytes as (select id, run, k, flatten(list_transform(c, lambda x: case when x < 128 then [x] else [192 + x // 64, 128 + x % 64] end)) as b from codes),
hashed as (select id, run, k, xor(list_reduce(list_concat([4294967295], b), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) as h from bytes, table256),
cut as (select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from hashed),
words as (select word, cast(sum(k) as bigint) as n from cut where length(word) >= 6 group by word having sum(k) >= 5),
less as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (select a.word, b.word as other from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word from less a join words b on a.rest = b.word union select b.word, a.word from less a join words b on a.rest = b.word),
ranked as (select near.word, other, words.n as other_n, row_number() over (partition by near.word order by words.n desc, other) as i, count(*) over (partition by near.word) as n_near from near join words on other = words.word),
forms as (select w.word, case when r.other_n >= 5 * w.n then r.other end as form, w.n, coalesce(r.n_near, 0) as n_near, case when r.other_n >= 5 * w.n then r.other_n end as form_n from words w left join ranked r on r.word = w.word and r.i = 1),
chain as (with recursive c as (select word, form as root from forms where form is not null union all select c.word, f.form from c join forms f on c.root = f.word where f.form is not null) select word, root from c),
ends as (select chain.word, chain.root from chain join forms f on f.word = chain.root where f.form is null)
select f.word, f.form, coalesce(ends.root, f.word) as root, f.n, f.n_near, f.form_n from forms f left join ends on ends.word = f.word""",
    "op13_embedding_near_dedup": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
good as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as w from good a join good b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach as (select u, u as root from links union select l.w, r.root from reach r join links l on l.u = r.u where r.root < l.w),
least as (select u, min(root) as root from reach group by u),
degree as (select u, count(*) as k from links group by u)
select vec_id, coalesce(k, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept,
  case when label is null or not exists (select 1 from good g where g.vec_id = e.vec_id) then 1 else count(*) over (partition by label, embedding) end as copies
from embeddings e left join least on least.u = vec_id left join degree on degree.u = vec_id""",
}
