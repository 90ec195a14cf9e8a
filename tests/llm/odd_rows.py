"""Rows that operators must survive."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), *[StructField(c, StringType()) for c in ("source", "score", "keep_id", "shard", "rid", "unit", "spans", "label", "features", "sequence_id", "lang_pred", "key", "token", "bin", "size", "n_chars")]])
LONG = " ".join(f"word{i % 5000} and" for i in range(40_000))
#: id, text, lang: a null text, empty and blank ones, copies, a repeated row, null ids, no letters, a very long text and one with odd characters.
ROWS = [
    (0, None, None), (1, "", "en"), (2, " \t\n ", None), (3, "The same text, twice here.", "en"), (4, "The same\n text,  twice here.", "en"), (5, "Der andere Text\nsteht hier.", "de"), (5, "Der andere Text\nsteht hier.", "de"),
    (None, "No id at all", "en"), (None, None, None), (6, "12 345 !!", None), (7, LONG, "en"), (8, "naïve 日本語 😀 \u0000 <|endoftext|> a  b \n c", None), (9, "one", "en"), (10, "idiot The same text", "en"),
]
