"""The nested document model as Spark types, and the closed vocabularies."""

from pyspark.sql import types as T

REFERENCE = T.StructType([T.StructField("type", T.StringType()), T.StructField("target", T.StringType())])
CHAIN = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
SECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("identifier", "heading", "content")] + [T.StructField("refs", T.ArrayType(REFERENCE)), T.StructField("norm_chains", T.ArrayType(CHAIN))])
VERSION = T.StructType([T.StructField("valid_from", T.TimestampType()), T.StructField("valid_to", T.TimestampType())])
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "short_title", "jurisdiction", "type")]
    + [T.StructField(n, T.TimestampType()) for n in ("published_at", "effective_from", "effective_to")]
    + [T.StructField("source_url", T.StringType()), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("versions", T.ArrayType(VERSION)), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
DOCUMENT_REF = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "source_key")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])

DOCUMENT_TYPES = ("unknown", "law", "order", "ruling")
REFERENCE_TYPES = ("unknown", "paragraph", "article", "law")
NODE_TYPES = ("unknown", "law", "paragraph", "ruling")
EDGE_TYPES = ("references", "cites", "replaces", "concretizes")
