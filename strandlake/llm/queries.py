"""The queries of the corpus operators: one ``opN_<name>`` each, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import ann, chat_format, language_id, line_dedup, lm_score, media, near_dedup, packing, token_files, word_bpe
from strandlake.llm.common import shared_path, table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10, shortlist=100, train_rows=8192)


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return word_bpe.encode(docs, vocabulary("word_bpe_49k.json"), lexicon_words=65_536, digests=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), percent=85, size=5)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), to, end_id=2, sample_docs=512)
    return token_files.read(spark, to)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


#: Two adjacent turns whose text has the template's own marks.
MARKS = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    read = chat_format.read_chats(chat_format.format_chats(rows.unionByName(marks)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.with_header(media.store(table(spark, sf_dir, "documents"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(table(spark, sf_dir, "documents"), train_rows=4000)
    return language_id.of_pages(table(spark, sf_dir, "pages"), model)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


KEY = r"translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": f"""
            with lines as (
                select doc_id, pos, line, {KEY} as key
                from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
            keys as (select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
            marked as (select l.doc_id, l.pos, l.line, k.key is not null and l.doc_id <> k.keeper as dropped from lines l left join keys k on l.key = k.key)
            select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
            from marked group by doc_id""",
        "op4_minhash_near_dedup": r"""
            with recursive w as (
                select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
            s as (
                select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')]
                    else list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' ')) end) as sh from w),
            n as (select doc_id, count(*) as n from s group by doc_id),
            shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
            links as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
            reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
            select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id, min(r.b) = d.doc_id as kept
            from documents d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
        "op7_chat_format": r"""
            with rows as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            safe as (
                select *, role || chr(10) || text || chr(10) as whole,
                       role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as fresh,
                       length(text) + length(text) - length(translate(text, '\#<' || chr(30), '')) as text_chars,
                       length(role) + length(role) - length(translate(role, '\#<:' || chr(30), '')) as role_chars from rows)
            select conv_id, count(*) as n_turns, sha256(string_agg(whole, '' order by turn, role, text)) as turns_sha256,
                   cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
                   sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
                   cast(sum(text_chars + case when fresh then role_chars + 15 else 1 end) as bigint) as formatted_chars
            from safe group by conv_id""",
    }
