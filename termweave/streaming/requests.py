"""Requests (JSON-RPC 2.0 messages) answered as a table: one row in, at most one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.resolve import guard, resolve
from termweave.sources.vocabulary import Vocabulary

MESSAGE = "jsonrpc string, id string, method string, params struct<name:string, arguments:struct<text:string, scopes:array<string>, tool_name:string, surface:string, term_id:string, limit:int, include_deprecated:boolean>>"
TOOLS = ("resolve_term", "check_language", "guard_tool_call", "find_evidence", "submit_proposal", "get_snapshot")
PARSE_ERROR, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


def parse(lines: DataFrame) -> DataFrame:
    """row_id, id (as JSON text), method, tool, args, error code. lines: row_id, value; batches are exploded before."""
    m = lines.select("row_id", "value", F.from_json("value", MESSAGE).alias("m"), F.get_json_object("value", "$.id").alias("id"))
    valid = F.trim("value").startswith("{") & F.trim("value").endswith("}") & F.col("m").isNotNull()
    known = F.col("m.method").isin("initialize", "ping", "tools/list", "tools/call", "notifications/initialized")
    code = F.when(~valid, F.when(F.try_parse_json("value").isNull(), PARSE_ERROR).otherwise(INVALID)).when(F.col("m.method").isNull(), INVALID).when(~known, NO_METHOD)
    quoted = F.regexp_extract("value", r'"id"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+)', 1)
    return m.select("row_id", F.when(quoted != "", quoted).otherwise("null").alias("id"), F.col("m.method").alias("method"), F.col("m.params.name").alias("tool"), F.col("m.params.arguments").alias("args"), code.alias("code"))


def explode_batches(lines: DataFrame) -> DataFrame:
    """Messages sent as one array become rows of their own."""
    many = F.trim("value").startswith("[")
    each = F.when(many, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return lines.select(F.col("row_id"), F.posexplode_outer(each).alias("pos", "value")).select(F.concat_ws(".", "row_id", "pos").alias("row_id"), F.coalesce("value", F.lit("")).alias("value"))


def answer(lines: DataFrame, v: Vocabulary, evidence: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """row_id, response: a JSON text for each message but notifications.

    Tools that resolve or gate texts run as one plan over all requests. Proposals are written by the store, not here.
    """
    p = parse(explode_batches(lines))
    calls = p.where("code IS NULL AND method = 'tools/call'").select("row_id", "id", "tool", F.col("args.text").alias("text"), F.col("args.scopes").alias("scopes"), F.col("args.tool_name").alias("tool_name"), F.col("args.term_id").alias("term_id"))
    asked = calls.where(F.col("tool").isin("resolve_term", "check_language") & F.col("text").isNotNull())
    r = resolve(asked, v, F.col("scopes"), id_col="row_id").withColumnRenamed("text_id", "row_id")
    said = r.join(asked.select("row_id", "tool"), "row_id").select("row_id", F.to_json(F.struct("tool", "status", "action", "term_ids", "primary_term_id", "message", (F.col("status") == "ambiguous").alias("requires_clarification"))).alias("result"))
    gated = calls.where((F.col("tool") == "guard_tool_call") & F.col("text").isNotNull() & F.col("tool_name").isNotNull())
    g = guard(gated, v, F.col("scopes"), id_col="row_id").withColumnRenamed("text_id", "row_id")
    said = said.unionByName(g.select("row_id", F.to_json(F.struct(F.lit("guard_tool_call").alias("tool"), "tool_name", "status", "action", "is_allowed", "allowed_tools", "term_ids")).alias("result")))
    if evidence is not None:
        ev = evidence.groupBy(F.col("owner_id").alias("term_id")).agg(F.array_sort(F.collect_list(F.struct("evidence_ord", "kind", "source_path", "snippet"))).alias("e"))
        found = calls.where("tool = 'find_evidence'").join(ev, "term_id", "left")
        said = said.unionByName(found.select("row_id", F.to_json(F.struct("tool", "term_id", F.coalesce("e", F.expr("array()")).alias("evidence"))).alias("result")))
    if snapshots is not None:
        newest = snapshots.orderBy(F.desc("created_at")).limit(5).agg(F.collect_list(F.struct("snapshot_id", "created_at")).alias("s"))
        said = said.unionByName(calls.where("tool = 'get_snapshot'").join(F.broadcast(newest), F.lit(True)).select("row_id", F.to_json(F.struct("tool", F.col("s").alias("snapshots"))).alias("result")))
    j = p.where("method IS NULL OR method <> 'notifications/initialized'").join(said, "row_id", "left")
    error = F.when(F.col("code") == PARSE_ERROR, "Parse error").when(F.col("code") == INVALID, "Invalid Request").when(F.col("code") == NO_METHOD, F.concat(F.lit("Method not found: "), "method"))
    tools = "{\"tools\":[" + ",".join(f'{{\"name\":\"{t}\"}}' for t in TOOLS) + "]}"
    missing = F.when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("")))).otherwise("missing or invalid arguments")
    content = lambda text, bad: F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), F.lit(bad).alias("isError")))
    result = (
        F.when(F.col("method") == "ping", "{}").when(F.col("method") == "tools/list", tools).when(F.col("method") == "initialize", '{"protocolVersion":"2024-11-05","capabilities":{"tools":{}},"serverInfo":{"name":"termweave","version":"0.1.0"}}')
        .when(F.col("result").isNotNull(), content(F.col("result"), False)).otherwise(content(F.to_json(F.struct(missing.alias("error"))), True))
    )
    body = F.when(F.col("code").isNotNull(), F.concat(F.lit('"error":'), F.to_json(F.struct("code", error.alias("message"))))).otherwise(F.concat(F.lit('"result":'), result))
    return j.select("row_id", F.concat(F.lit('{"jsonrpc":"2.0","id":'), "id", F.lit(","), body, F.lit("}")).alias("response"))


def serve(stream: DataFrame, v: Vocabulary, target: str, checkpoint: str):
    """Answer a stream of lines (value) in micro-batches; responses are appended as text files under target."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.md5("value").alias("row_id"), "value").distinct()  # equal lines get one answer
        answer(rows, v, v.evidence).select(F.col("response").alias("value")).write.mode("overwrite").text(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
