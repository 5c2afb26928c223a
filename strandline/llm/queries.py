"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import learn, score_texts

    docs = _table(spark, sf_dir, "documents")
    scored = score_texts(docs, learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "score", "predicted", "spans")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), _tokenizer())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .run_index import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, format_turns

    known = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], known.schema)
    return conversation_digests(format_turns(known.unionByName(more)))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_chat": op10_chat,
}

SQL = {
    "op3_jaccard_join": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')]
                 else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
        r as (select doc_id as id, doc_id as c from documents union select l.b, r.c from r join l on l.a = r.id),
        m as (select id, min(c) as c from r group by id),
        k as (select doc_id, min(doc_id) over (partition by gs) as class_id from (select doc_id, list_sort(list(g)) as gs from s group by doc_id))
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, coalesce(k.class_id, d.doc_id) as class_id
        from documents d join m on m.id = d.doc_id left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id""",
    "op8_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op9_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
        u as (select vec_id, label, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
              where list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (select vec_id as id, vec_id as c from embeddings union select l.b, r.c from r join l on l.a = r.id),
        m as (select id, min(c) as c from r group by id),
        d as (select a, count(*) as n from l group by a)
        select vec_id, coalesce(d.n, 0) as n_links, m.c as component_id, vec_id = m.c as kept
        from embeddings join m on m.id = vec_id left join d on d.a = vec_id""",
}
