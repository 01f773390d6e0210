"""Schemas of the stored tables."""

from pyspark.sql import types as T

_s, _i, _l, _d, _b, _t = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENTS = _struct(
    doi=_s, has_dataset_citation=_b, full_text=T.ArrayType(_s), total_char_length=_i, parsed_timestamp=_t, total_chunks=_i, total_tokens=_i,
    avg_tokens_per_chunk=T.FloatType(), file_hash=_s, file_path=_s, citation_entities=T.ArrayType(_s), n_pages=_i, created_at=_t, updated_at=_t)
CITATIONS = _struct(data_citation=_s, document_id=_s, pages=T.ArrayType(_i), evidence=T.ArrayType(_s), created_at=_t)
CHUNKS = _struct(
    chunk_id=_s, document_id=_s, chunk_text=_s, score=T.FloatType(),
    chunk_metadata=_struct(created_at=_t, previous_chunk_id=_s, next_chunk_id=_s, token_count=_i, citation_entities=T.ArrayType(_s)), created_at=_t)
DATASETS = _struct(
    dataset_id=_s, document_id=_s, total_tokens=_i, avg_tokens_per_chunk=T.FloatType(), total_char_length=_i, clean_text_length=_i, cluster=_s, dataset_type=_s, text=_s, created_at=_t, updated_at=_t)
FEATURES = _struct(dataset_id=_s, document_id=_s, feature_name=_s, feature_value=_d, created_at=_t, updated_at=_t)
MODELS = _struct(model_hash=_s, trained_at=_t, best_f1=_d, path=_s)
LABELS = _struct(article_id=_s, dataset_id=_s, type=_s)
VECTORS = _struct(id=_s, text=_s, metadata=T.MapType(_s, _s), embedding=T.ArrayType(T.FloatType()))

#: Keys by which rows are replaced.
KEYS = {"documents": ["doi"], "citations": ["data_citation", "document_id"], "chunks": ["chunk_id"], "datasets": ["dataset_id", "document_id"], "features": ["dataset_id", "document_id", "feature_name"], "models": ["model_hash"]}
