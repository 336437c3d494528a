"""Schemas of the tables that operators take and return."""

from pyspark.sql import types as T

RELATION = T.StructType([T.StructField("relation", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
METADATA = T.StructType([T.StructField("topic", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("relations", T.ArrayType(RELATION))])
CORPUS_JSON = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("metadata", METADATA), T.StructField("_corrupt_record", T.StringType())])
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("metadata", METADATA)])
CHUNKS = T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("position", T.IntegerType(), False)])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("term", T.StringType())])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("tf", T.LongType())])
QUERIES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([T.StructField("vec_id", T.StringType(), False), T.StructField("ord", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("metadata", T.StringType())])
NODES = T.StructType([T.StructField("node_id", T.StringType(), False), T.StructField("node_type", T.StringType()), T.StructField("metadata", T.StringType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("edge_type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("metadata", T.StringType()), T.StructField("ord", T.LongType())])
RANKED = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
QRELS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("relevance", T.DoubleType())])
