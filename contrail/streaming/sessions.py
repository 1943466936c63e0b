"""Event logs as streams: the live fold of a session, log lines, and running a stream over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contrail.operators.replay import log_line, with_fields

STATE = "session_id string, status string, phase string, progress double, layer int, best_layer int, best_strength double, overall double, valid_pairs long, llm_calls long, last_sequence long"


def apply_event(state: dict, kind: str, payload: dict) -> dict:
    """One step of the live fold; before session.started nothing happens."""
    if kind == "session.started":
        return state if state["status"] else state | {"status": "running", "phase": "initializing"}
    if not state["status"]:
        return state
    raise_to = lambda x: max(state["progress"], x)
    if kind == "session.completed":
        done = bool(payload.get("success"))
        state = state | {"status": "completed" if done else "failed", "phase": "complete" if done else "failed", "progress": 1.0}
        if payload.get("final_score") is not None:
            state["overall"] = float(payload["final_score"])
        if payload.get("final_layer") is not None:
            state["best_layer"] = int(payload["final_layer"])
    elif kind == "contrast.pipeline_started":
        state = state | {"phase": "generating"}
    elif kind == "contrast.pair_validated":
        state = state | {"valid_pairs": state["valid_pairs"] + bool(payload.get("is_valid"))}
    elif kind == "optimization.started":
        state = state | {"phase": "optimizing"}
    elif kind == "llm.response":
        state = state | {"llm_calls": state["llm_calls"] + 1}
    elif kind == "vector.created":
        state = state | {"layer": int(payload.get("layer") or 0), "phase": "optimizing", "progress": raise_to(0.5)}
    elif kind == "vector.selected":
        layer = payload.get("layer")
        state = state | {"layer": state["layer"] if layer is None else int(layer), "best_layer": layer, "best_strength": float(payload.get("strength") or 1.0)}
    elif kind == "evaluation.started":
        state = state | {"phase": "evaluating", "progress": raise_to(0.7)}
    elif kind == "evaluation.completed":
        state = state | {"overall": float((payload.get("scores") or {}).get("overall") or 0.0), "phase": "review", "progress": raise_to(0.9)}
    return state


EMPTY = {"status": "", "phase": "", "progress": 0.0, "layer": None, "best_layer": None, "best_strength": 1.0, "overall": 0.0, "valid_pairs": 0, "llm_calls": 0, "last_sequence": -1}


def stream_logs(events: DataFrame) -> DataFrame:
    """session_id, sequence, log_source, message, level; stateless."""
    source, message, level = log_line()
    return with_fields(events.where("event_type <> 'llm.chunk'")).select("session_id", "sequence", source.alias("log_source"), message.alias("message"), level.alias("level"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run until everything that is there is done, what the last watermark lets go included, then stop; results as Parquet under path (append) or, in update
    mode, each trigger's rows with batch_id. A trigger that is run again replaces what it wrote."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch_id={i}")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = stream.schema if mode == "append" else stream.schema.add("batch_id", "long")
    return spark.read.schema(out).parquet(path)
