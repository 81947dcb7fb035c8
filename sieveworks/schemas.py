"""The data model: explicit schemas, never inferred ones."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = _struct(path=_S, text=_S)
ARTICLE = _struct(input=_S, answer=_S)
QA = _struct(title=_S, question=_S, reply=_S)
CHUNK = _struct(text=_S, source=_S, title=_S, section=_S, chunk_id=_L)
VECTOR = _struct(chunk_id=_L, embedding=T.ArrayType(T.FloatType()))
HIT = _struct(query_id=_L, chunk_id=_L, rank=_I, score=_D)
TEST_ITEM = _struct(query=_S, relevant_ids=T.ArrayType(_L))
QA_TEST = _struct(question=_S, reply=_S)
RESULT = _struct(question=_S, ground_truth=_S, generated_answer=_S, contexts=T.ArrayType(_S), use_rag=_B)
INFERENCE_FILE = T.StructType(
    [
        T.StructField("config", _struct(model=_S, use_rag=_B, retriever=_S, top_k=_I)),
        T.StructField("time", _S),
        T.StructField("results", T.ArrayType(RESULT)),
    ]
)
LABEL = _struct(id=_S, label=_S)
PREDICTION = _struct(id=_S, pred=_S)
SFT = _struct(instruction=_S, input=_S, output=_S)
DPO = _struct(instruction=_S, input=_S, chosen=_S, rejected=_S)
MESSAGE = _struct(role=_S, content=_S)
METRICS = T.StructType([T.StructField("method", _S), *[T.StructField(f"{m}_{k}", _D) for m in ("hit", "recall") for k in (1, 5, 10, 20)], T.StructField("mrr", _D), T.StructField("n_queries", _L)])
