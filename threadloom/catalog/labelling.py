"""Prompts, transcripts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import registry as rg
from threadloom.catalog.registry import BLANK, REPS, query, strip_sql
from threadloom.functions import text as tx
from threadloom.functions import words as wd
from threadloom.operators import labelling as lb
from threadloom.operators import tokens as tk
from threadloom.operators.numbering import even_blocks
from threadloom.session import cut_lineage


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "build_prompts",
    f"""WITH {REPS}, kw AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS k FROM ranked WHERE rank <= 10 GROUP BY ALL),
    ds AS (SELECT topic, string_agg('- ' || text || chr(10), '' ORDER BY rank) AS d FROM reps JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL)
    SELECT topic, md5(replace(replace({literal(wd.PROMPT_LABEL)}, '[KEYWORDS]', k), '[DOCUMENTS]', d)) AS prompt FROM kw JOIN ds USING (topic)""",
)
def _(spark, d):
    prompts = lb.build_prompts(*rg.words_and_docs(spark, d))
    return prompts.select("topic", rg.digest("prompt").alias("prompt"))


@query(
    "chat_messages",
    f"""WITH {REPS}, docs AS (SELECT topic, rank, text FROM reps JOIN documents USING (doc_id) WHERE rank <= 3)
    SELECT topic, 0::BIGINT AS seq, 'user' AS role, md5({literal(wd.PROMPT_CHAT_START)}) AS content FROM docs GROUP BY topic
    UNION ALL SELECT topic, rank, 'user', md5(replace({literal(wd.PROMPT_CHAT_DOCUMENT)}, '[DOCUMENTS]', '- ' || text || chr(10))) FROM docs
    UNION ALL SELECT topic, max(rank) + 1, 'user', md5({literal(wd.PROMPT_CHAT_END)}) FROM docs GROUP BY topic""",
)
def _(spark, d):
    messages = lb.chat_messages(rg.representative(spark, d))
    return messages.select("topic", "seq", "role", rg.digest("content").alias("content"))


@query(
    "summary_messages",
    rf"""WITH t AS (SELECT regexp_split_to_array(string_agg(text, ' ' ORDER BY doc_id), '{BLANK}+') AS w FROM documents),
    f AS (SELECT list_filter(w, lambda x: x <> '') AS w FROM t),
    c AS (SELECT w, unnest(range(0, ceil(len(w) / 512.0)::BIGINT)) AS chunk FROM f)
    SELECT chunk // 7 AS chat, chunk % 7 + 1 AS seq, 'user' AS role,
        md5({literal(wd.PROMPT_SUMMARY_CHUNK)} || array_to_string(list_slice(w, chunk * 512 + 1, chunk * 512 + 512), ' ')) AS content FROM c
    UNION ALL SELECT DISTINCT chunk // 7, 0::BIGINT, 'user', md5({literal(wd.PROMPT_SUMMARY_START)}) FROM c
    UNION ALL SELECT chunk // 7, max(chunk % 7) + 2, 'user', md5({literal(wd.PROMPT_SUMMARY_END)}) FROM c GROUP BY 1""",
)
def _(spark, d):
    chunks = cut_lineage(tk.corpus_chunks(even_blocks(rg.documents(spark, d), "doc_id"), ["doc_id"], F.col("_even")))
    return lb.summary_messages(chunks).select("chat", "seq", "role", rg.digest("content").alias("content"))


def raw_answers(spark, d):
    """An answer per document, as a model server sends it: JSON lines and one line that is no JSON."""
    text = F.col("document")
    half = F.floor(F.char_length("document") / 2).cast("int")
    message = F.to_json(
        F.struct(F.struct(F.lit("assistant").alias("role"), F.substring(text, F.lit(1), half).alias("content")).alias("message"))
    )
    rest = F.to_json(F.struct(F.substring(text, half + 1, F.char_length("document")).alias("response")))
    return rg.documents(spark, d).select("doc_id", F.concat_ws("\n", message, F.lit("not json"), F.lit(""), rest).alias("raw"))


@query("parse_ndjson", "SELECT doc_id, md5(text) AS response, 1::BIGINT AS messages FROM documents")
def _(spark, d):
    raw = F.col("raw")
    return raw_answers(spark, d).select(
        "doc_id", F.md5(tx.parse_ndjson(raw)).alias("response"), F.size(tx.parse_ndjson_messages(raw)).alias("messages")
    )


@query(
    "extract_label",
    f"""SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN {strip_sql("split_part(text, chr(10), 1)")}
        ELSE {strip_sql("text")} END) AS label FROM conversations""",
)
def _(spark, d):
    table = rg.read_table(spark, d, "conversations")
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    answer = F.when(
        F.col("role") == "user", F.concat(F.lit("Sure. Topic: "), first, F.lit("\nTopic: "), F.col("text"))
    ).otherwise(F.col("text"))
    return table.select("conv_id", "turn", F.md5(tx.extract_label(answer)).alias("label"))


def first_keyword(prompt: str) -> str:
    """A stand-in for a model: answers with the first keywords of the prompt."""
    words = prompt.split("keywords: ", 1)[-1].split("\n", 1)[0]
    return "The topic is: " + ", ".join(words.split(", ")[:3])


@query(
    "label_topics",
    f"""WITH {rg.SCORES} SELECT topic, string_agg(word, ', ' ORDER BY rank) AS label FROM ranked WHERE rank <= 3 GROUP BY ALL""",
)
def _(spark, d):
    return lb.label_topics(*rg.words_and_docs(spark, d), first_keyword)
