import pytest

CLASHES = ["n_words", "kept", "doc", "row", "_row", "words", "items", "spans", "fp", "root", "_words", "_lang", "ids"]
CLASHES += ["_base", "_weak", "_scanned", "_more", "_at", "_found_d", "_bad_d", "_bad_lang", "_bad_source"]
CLASHES += ["_stay_id", "_stay_d", "_scored", "_digest", "_spans"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from texts: ids count up, and columns whose names clash are there on request."""

    def build(texts, ids=None, clash=False, langs=None, sources=None):
        n = len(texts)
        rows = [
            (
                (ids[i] if ids else i),
                texts[i],
                langs[i] if langs else "en",
                sources[i] if sources else "s",
                None if texts[i] is None else len(texts[i]),
            )
            for i in range(n)
        ]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df.repartition(3)

    return build
