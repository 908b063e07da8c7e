import pytest

#: Texts that any operator must stand: null, empty, blank, one word, repeats, copies, personal data, licenses, secrets, odd characters.
TEXTS = [
    None,
    "",
    " \t\n\v\f\r ",
    "word",
    "the quick brown fox jumps over the lazy dog " * 12,
    "the quick brown fox jumps over the lazy dog " * 12,
    "a b\na b\n\nc d\na b\n" + "x " * 30,
    "mail me at john.doe+x@mail.example.com, a@b.c@d.e or @nobody; 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, call +1 (415) 555-2671 or +12; iban DE89 3704 0044 0532 0130 00",
    "Licensed under the Apache License, Version 2.0. GNU General Public License. CC BY-NC. MIT License mit\nlicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and again token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "naïve café ÉÈ \U0001f600 日本語   x\u0085y <|endoftext|> it's 12345 !!??  two  spaces\n \n end ",
    "$$$ spam### buy&&& now%%% " * 10,
    "1" * 30000 + "@" + "a" * 30000,
    " ".join(f"w{i % 97}" for i in range(20000)),
    "é" * 5000,
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """TEXTS with ids, a null id, a repeated row, and columns whose names clash with what operators add."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 4 else f"src{i % 3}", len(t or ""), f"s{i}", -1, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all here", None, "src0", 17, "s", -1, 7), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long, shard int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, docs):
    """A folder with the documents as a query reads them."""
    folder = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
