"""ONNX encoder over Arrow batches.

Plan: scan -> tokenise in the JVM (built-in split/regex) -> ``mapInPandas``.
No shuffle: each task opens one inference session (cached per Python worker
and reused across tasks), takes a batch in parts of a bounded size, maps
tokens to ids with a broadcast vocabulary, sorts a part's rows by length, cuts them into model calls of at
most ``max_batch_tokens`` padded tokens, pools each call in numpy and emits
one row per text. Hidden states never leave the task.

A failing call is retried row by row, so one bad text gives one error row
and the rest of its batch still gets embeddings.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.operators.batches import PART_ITEMS, PART_ROWS, POOLED_VALUES, cuts
from lumenvec.operators.tokens import RowIds, raw_tokens, sent_vocabulary, task_ids
from lumenvec.profiles import Profile
from lumenvec.sources.vocab import Vocabulary

# Between the raw tokens of a text: white space, which neither tokenizer leaves in a token.
BETWEEN = "\n"

OUTPUT_SCHEMA = (
    "doc_id bigint, pooled array<double>, mask_sum double, n_tokens bigint, "
    "inference_time double, setup_time double, call_seq int, call_time double, call_id string, error string"
)


@dataclass(frozen=True)
class OnnxEncoder:
    model_path: str | None = None  # on storage every executor can read
    model_bytes: bytes | None = None  # small models: shipped by broadcast
    dim: int = 768
    max_batch_tokens: int = 32768  # rows x padded length per model call
    max_batch_rows: int = 64
    threads: int = 1  # intra-op threads; tasks x threads should fit the cores
    runtime: str = "onnx"


_SESSIONS: dict = {}


def _session(key, enc_threads: int, model_bytes, model_path):
    """One inference session per Python worker and model; True if new."""
    if key in _SESSIONS:
        return _SESSIONS[key], False
    import onnxruntime as ort

    so = ort.SessionOptions()
    so.intra_op_num_threads = enc_threads
    so.inter_op_num_threads = 1
    src = model_bytes if model_bytes is not None else model_path
    sess = ort.InferenceSession(src, so, providers=["CPUExecutionProvider"])
    _SESSIONS[key] = sess
    return sess, True


def _runner(enc: OnnxEncoder, profile: Profile, bc_vocab, bc_model, model_key, extra):
    most = max(1, min(PART_ROWS, POOLED_VALUES // max(enc.dim, 1)))

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        t0 = time.perf_counter()
        sess, fresh = _session(model_key, enc.threads, bc_model.value if bc_model is not None else None, enc.model_path)
        setup = time.perf_counter() - t0 if fresh else None
        out_name = profile.output_name
        names = [out_name] if out_name else None
        shipped, unk_id = bc_vocab[0].value, bc_vocab[1]
        made = RowIds(shipped, profile, unk_id, shipped[0].get(profile.unk, unk_id))
        call_seq, task_run = 0, uuid.uuid4().hex  # calls are told apart across tasks

        def model_call(rows, task):
            b = len(rows)
            L = max(len(r) for r in rows)
            ids = np.zeros((b, L), dtype=np.int64)
            mask = np.zeros((b, L), dtype=np.int64)
            for k, r in enumerate(rows):
                ids[k, : len(r)] = r
                mask[k, : len(r)] = 1
            feeds = {"input_ids": ids, "attention_mask": mask}
            if profile.uses_token_types:
                feeds["token_type_ids"] = np.zeros_like(ids)
            else:
                feeds["task_id"] = np.array([task], dtype=np.int64)
            began, r0 = time.time(), time.perf_counter()
            hidden = sess.run(names, feeds)[0]
            span = time.perf_counter() - r0
            # One text at a time in float64: never a second copy of the whole tensor.
            m = mask.astype(np.float64)
            msum = m.sum(axis=1)
            mean = [(hidden[k].astype(np.float64) * m[k][:, None]).sum(axis=0) / max(msum[k], 1e-9) for k in range(b)]
            return mean, msum, span, began

        for pdf in (whole.iloc[lo:hi] for whole in batches for lo, hi in cuts(whole["tokens"].str.len(), most, 8 * PART_ITEMS)):
            nrow = len(pdf)
            pooled = [None] * nrow
            msums = np.zeros(nrow)
            times = np.full(nrow, np.nan)
            seqs = np.full(nrow, -1, dtype=np.int64)
            began = np.full(nrow, np.nan)
            errs = list(pdf["task_error"]) if "task_error" in pdf else [None] * nrow
            tasks = pdf["task_id"].to_numpy() if "task_id" in pdf else np.zeros(nrow)
            s0 = time.perf_counter()
            at, flat = made.of(pc.split_pattern(pa.array([x or None for x in pdf["tokens"]], pa.string()), BETWEEN))
            ntok = np.where([e is None for e in errs], np.diff(at), 0)
            seqs_ids = [flat[x:y] for x, y in zip(at[:-1], at[1:])]
            tok_time = np.full(nrow, (time.perf_counter() - s0) / nrow)
            todo = [k for k in range(nrow) if errs[k] is None]
            todo.sort(key=lambda k: (tasks[k], ntok[k]))
            chunks, cur = [], []
            for k in todo:
                if cur and (
                    tasks[cur[0]] != tasks[k]
                    or len(cur) >= enc.max_batch_rows
                    or (len(cur) + 1) * ntok[k] > enc.max_batch_tokens
                ):
                    chunks.append(cur)
                    cur = []
                cur.append(k)
            if cur:
                chunks.append(cur)
            for ch in chunks:
                try:
                    res, ms, span, start = model_call([seqs_ids[k] for k in ch], int(tasks[ch[0]]))
                    span /= len(ch)
                    for j, k in enumerate(ch):
                        pooled[k], msums[k], times[k], seqs[k] = res[j], ms[j], tok_time[k] + span, call_seq
                        began[k] = start
                    call_seq += 1
                except Exception:  # noqa: BLE001 - retry row by row
                    for k in ch:
                        try:
                            res, ms, span, start = model_call([seqs_ids[k]], int(tasks[k]))
                            pooled[k], msums[k] = res[0], ms[0]
                            times[k], seqs[k], began[k] = tok_time[k] + span, call_seq, start
                        except Exception as e:  # noqa: BLE001
                            errs[k] = f"inference: {e}"
                        call_seq += 1
            setup_col = [None] * nrow
            if setup is not None and nrow:
                setup_col[0] = setup
                setup = None
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(pdf["doc_id"], dtype="Int64"),  # may be null
                    "pooled": pooled,
                    "mask_sum": msums,
                    "n_tokens": ntok,
                    "inference_time": [None if np.isnan(t) else float(t) for t in times],
                    "setup_time": setup_col,
                    "call_seq": [None if s < 0 else int(s) for s in seqs],
                    "call_time": [None if np.isnan(t) else float(t) for t in began],
                    "call_id": [None if s < 0 else f"{task_run}-{s}" for s in seqs],
                    "error": errs,
                    **{c: pdf[c].array for c in extra},
                }
            )

    return run


def encode_onnx(
    texts: DataFrame,
    vocab: Vocabulary,
    profile: Profile,
    enc: OnnxEncoder,
    text_col: str = "text",
    id_col: str = "doc_id",
    tasks: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Texts -> pooled rows via the ONNX model; one output row per text."""
    from lumenvec.session import ship_package

    spark = texts.sparkSession
    ship_package(spark)
    with_task = ["task"] if "task" in texts.columns and not profile.uses_token_types else []
    named = texts.withColumns({f"keep_{c}": F.col(c) for c in keep or []})
    extra = [f"keep_{c}" for c in keep or []]
    nested = raw_tokens(named, profile, text_col, id_col, [*with_task, *extra])
    # One string a text: lists would become an object for each token of a whole batch.
    nested = nested.withColumn("tokens", F.array_join("tokens", BETWEEN))
    if not profile.uses_token_types:
        if tasks is None:
            raise ValueError("this profile's model takes a task id: pass the task list")
        if not with_task:
            nested = nested.withColumn("task", F.lit(profile.task))
        nested = task_ids(nested, tasks, profile).drop("task")
    sc = spark.sparkContext
    bc_vocab = sent_vocabulary(vocab, profile)
    bc_model = sc.broadcast(enc.model_bytes) if enc.model_bytes is not None else None
    key = (enc.model_path, None if enc.model_bytes is None else hash(enc.model_bytes), enc.threads)
    kinds = dict(nested.dtypes)
    schema = ", ".join([OUTPUT_SCHEMA, *[f"`{c}` {kinds[c]}" for c in extra]])
    return nested.mapInPandas(_runner(enc, profile, bc_vocab, bc_model, key, extra), schema)
