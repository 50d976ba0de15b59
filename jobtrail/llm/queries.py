"""Registered queries of this subpackage and their SQL. Each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import (chat, decontam, fim, jaccard, langid, mixing, quality, rules, secrets, simhash, toxicity, urlfilter,
                          vectorcodes)
from jobtrail.llm.tables import read


def _held_out(parts: int, rest: int) -> str:
    """Condition: the crc32 of the id as text leaves ``rest``. A null id is not held out and never learned from."""
    return f"crc32(encode(cast(doc_id as string), 'UTF-8')) % {parts} = {rest}"


#: Schemas of the tools that ``tool_messages`` calls.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("lookup", "query", "string", True),
         ("translate", "query", "string", True), ("translate", "limit", "number", False), ("translate", "target", "string", True)]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool traffic: each user turn is a call (its text the query), each assistant turn the
    result of the call right before it. A call needs the result of the call at half its turn, if there is one."""
    turn = F.col("turn")
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), (turn % 3 + 1).cast("int"))
    identifier = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    limit = F.when(turn % 5 == 4, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    query = F.expr("coalesce(substring(to_json(array(text)), 2, length(to_json(array(text))) - 2), 'null')")
    after = F.when(turn > 0, F.concat(F.lit('"'), identifier(F.floor(turn / 2)), F.lit('"'))).otherwise(F.lit(""))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), identifier(turn), F.lit('","name":"'), name, F.lit('","arguments":{"query":'), query, F.lit(',"limit":'), limit, F.lit('},"after":['), after, F.lit("]}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), identifier(turn - 1), F.lit('","content":'), query, F.lit("}"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select("conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    return chat.link_calls(tool_messages(read(spark, sf_dir, "conversations")), schemas)


OP1_SQL = r"""
WITH RECURSIVE calls AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
results AS (SELECT conv_id, turn, turn - 1 AS call_turn, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
depth AS (
    SELECT conv_id, turn, 0 AS level FROM calls c WHERE turn = 0 OR NOT EXISTS (FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn // 2)
    UNION ALL SELECT c.conv_id, c.turn, d.level + 1 FROM calls c JOIN depth d ON c.conv_id = d.conv_id AND c.turn > 0 AND c.turn // 2 = d.turn),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS position FROM depth),
linked AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.turn, r.turn AS result_turn, coalesce(c.turn, r.call_turn) AS no, c.text, r.content,
    CASE c.turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'translate' END AS name, r.turn IS NOT NULL AS answered
    FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.call_turn),
checked AS (SELECT *, CASE WHEN turn IS NULL THEN NULL WHEN name = 'search' THEN CASE WHEN turn % 5 = 4 THEN 'type limit' ELSE '' END
    WHEN name = 'lookup' THEN 'unknown limit' ELSE 'missing target' || CASE WHEN turn % 5 = 4 THEN '; type limit' ELSE '' END END AS errors FROM linked)
SELECT CAST(k.conv_id AS VARCHAR) AS conv_id, 'call-' || no AS call_id, name, coalesce(k.turn, result_turn) AS turn, o.level, o.position,
    CASE WHEN k.turn IS NULL THEN 'no_call' WHEN errors <> '' THEN 'invalid' WHEN NOT answered THEN 'no_result' ELSE 'ok' END AS status, errors,
    CASE WHEN k.turn IS NOT NULL THEN '{"arguments":{"limit":' || CASE WHEN k.turn % 5 = 4 THEN '"' || k.turn || '"' ELSE CAST(k.turn AS VARCHAR) END
        || ',"query":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '},"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
        || ',"id":"call-' || k.turn || '","name":"' || name || '"}' END AS json
FROM checked k LEFT JOIN ordered o ON k.conv_id = o.conv_id AND k.turn = o.turn
"""


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out(3, 1)
    scored = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), f"not ({held})")
    return scored.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out(4, 2)
    found = langid.identify(read(spark, sf_dir, "documents"), f"not ({held})", ["doc_id"])
    return found.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(read(spark, sf_dir, "documents")), 2)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (F.col("failed").bitwiseAND(F.lit(rules.mask(1))) != 0).alias("base_failed"), "kept", "failed")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85).drop("text_hash")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op7_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out(4, 2)
    scored = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), f"not ({held})")
    return scored.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


#: URL rules: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(read(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_quality_score, op3_language_id, op4_rule_ledger, op5_ngram_jaccard, op6_secret_scan,
                                   op7_toxicity_score, op8_source_mix, op9_url_filter, op10_decontamination,
                                   op11_simhash, op12_vector_codes, op13_fill_in_middle)}

ORACLES = {
    "op1_tool_calls": OP1_SQL,
    "op4_rule_ledger": rules.ledger_sql(),
    "op8_source_mix": mixing.mix_sql(),
    "op9_url_filter": urlfilter.judge_sql(URL_RULES),
    "op12_vector_codes": vectorcodes.codes_sql(),
    "op13_fill_in_middle": fim.fim_sql(),
}
