"""Tables that the tests of this folder share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, extra=False):
    """documents of the given texts; with extra, columns with clashing names."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = DOCS
    if extra:
        rows = [(*r, 1, "x", 2.0, 3, "y") for r in rows]
        schema += ", size long, fp string, score double, component_id long, `hit.x` string"
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
