from __future__ import annotations

import pytest

#: Rows that every operator has to take: nulls, empty and very long texts, ties, repeated rows, clashing names.
LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000))
COPY = " ".join(f"copy{i}" for i in range(120))
TEXTS = [
    None, "", " \t\n ", "one", "one two three four", COPY, COPY, COPY.replace("copy7 ", "changed "), LONG, "x" * 20_000,
    "a  b\n\n c \x0b d", "line\nline\nline\n" * 40, "日本語のテキスト です", "😀 😀 éß Ünïcode <|endoftext|> <s>", "12 34 -- !!", COPY.upper(),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """All of TEXTS, some rows twice, with null ids, languages and sources, and columns named like the operators' own."""
    langs, sources = ["en", "de", None], ["a", "b", None, "a"]
    rows = [(i, t, langs[i % 3], sources[i % 4], len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[3], (None, COPY, None, None, None), (None, None, None, None, None)]
    names = ["kept", "_stats", "_text", "row", "shard", "k", "_host", "slot", "item", "tokens", "_key"]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *[f"own {n}" for n in names]) for r in rows], kinds).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def table_dir(root, **tables):
    """A folder of Parquet tables as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)
