from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHING = "id string, fp string, text_hash string, root string, _id string, _hash string, bucket string, items string, held_out string, lang_pred string"


@pytest.fixture(scope="session")
def make(spark):
    """documents rows (doc_id, text, lang) with further columns that clash."""

    def of(rows):
        return spark.createDataFrame([(i, t, lang, *["x"] * 10) for i, t, lang in rows], f"doc_id long, text string, lang string, {CLASHING}")

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, texts without words or letters, repeated rows and ids."""
    return make(
        [
            (1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "the cat sat on the mat", None), (3, None, "en"), (4, "", "en"), (None, "der Hund läuft über die Straße", "de"),
            (None, None, None), (5, " \n\t ", "fr"), (6, "12 + 30 = 42 !!", None), (7, "word " * 60_000, "en"), (8, "日本語のテキスト<|endoftext|>▁x\x00y", None), (9, "y" * 3000, None),
        ]
    )


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
