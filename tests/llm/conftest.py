import pytest

#: Texts that have broken text code before: nulls, blanks, runs of white space, other alphabets, special tokens.
ODD = [
    None, "", " ", "\n", "  two  blanks ", "line\n\n\nline\n", " \n a", "a \n b\t c", "tab\tand\x0bvt\x0c \r\nend ", "\x1c x \x1f",
    " nbsp em　", "a<|endoftext|> b", "x <|endoftext|>y<|startoftext|>!", "<|endoftext|!! <|endoftext|", "don't I'LL we've o'clock's",
    "naïve café Straße İstanbul ΣΑΣ é ́a", "漢字 かな 한글", "🙂🙂 👩‍👩‍👧", "1234567 12.5% a1b2", "word.,!? w*** x### |y|", "a" * 3000,
    "é" * 500 + " " * 500 + "z", "same text", "same text", "a​ b", "� \x00 nul",
]


@pytest.fixture
def odd(spark):
    """Rows with odd texts, a repeated and a null key, and columns whose names operators use themselves."""
    rows = [(i if i != 5 else None, t, "en", "n_tokens") for i, t in enumerate(ODD)] + [(3, "twice the key", "de", "start"), (3, "twice the key", "de", "ids")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids string").repartition(3)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
