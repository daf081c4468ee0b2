"""Tables with odd rows for the tests of this folder."""

ODD = [None, "", " \n\t ", "x", "x " * 400, "a b c d e f g h i j k l m", "z a b c d e f g h i j k l m  o", "z A b c d e f g h i j k l m  o", "z a b c d e f g h i j k l n", "日本 \U0001f600 é ́", "y" * 30000]


def documents(spark, sf, more=()):
    """(doc_id, text) rows of the documents and odd ones with negative ids, as a list and as a table with other columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1 - i, t) for i, t in enumerate([*ODD, *more])]
    rows = [tuple(r) for r in docs.collect()] + odd
    return rows, spark.createDataFrame([(d, t, i, None) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_words long, h string").repartition(3)


def differences(df, want):
    """The wanted rows (dicts whose first column is the key) that the table doesn't have so."""
    want = list(want)
    columns = list(want[0])
    got = {r[columns[0]]: tuple(r) for r in df.select(*columns).collect()}
    assert len(got) == len(want)
    return [w for w in want if got.get(w[columns[0]]) != tuple(w.values())][:3]
