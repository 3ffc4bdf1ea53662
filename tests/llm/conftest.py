import pytest

WORDS = "ash bay cod dew elm fig gum hay ivy jay kin log map nut oak pea rye sun tea urn vat web yak zip".split()
LONG = "tide " * 100_000
# Names that the operators use inside.
CLASHING = [
    "id", "print", "hashes", "node", "label", "position", "words", "items", "starts", "removed_",
    "bucket", "windows", "line", "__text_", "signature", "first", "key", "toxic_", "links",
]


@pytest.fixture(scope="session")
def table(spark):
    """Documents (doc_id, text, lang) of the given rows, with columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHING)
        full = [(i, t, lang, *range(len(CLASHING))) for i, t, lang in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    prose = " ".join(WORDS)
    return [
        (3, prose, "en"),
        (3, prose, "en"),
        (3, "another text of the same id", "en"),
        (1, prose, "en"),
        (2, None, "fr"),
        (4, "", "fr"),
        (5, " \n\t \n", None),
        (None, prose, "en"),
        (None, None, None),
        (6, LONG, "de"),
        (7, "١٢٣ 🎉 -- 12 !?", "en"),
        (8, "one", "en"),
    ]
