"""A small folder of tables: the driver's smallest documents and rows that are awkward in every way."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from tidemark.llm.licenses import TEXTS

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} and w{i % 31}." for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

LICENSE = TEXTS["mit"]


def thue_morse(levels: int) -> tuple[str, str]:
    """Two words of as many bytes, over the same two letters, that polynomials modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, repeated rows, ties and shared passages."""
    one, other = thue_morse(12)
    same = [f"lead{i} of it" for i in range(7)]
    para = "The small harbour town kept its lamps lit through the long winter, and every boat that came home late found the quay by their glow. " * 2
    return [
        (9001, None, "en", "s1"),
        (9002, "", "en", "s1"),
        (9003, " \n\t ", None, None),
        (None, "a row without an id, twenty words or so, to see what becomes of it in each of the ten operators here today", "en", "s1"),
        (None, None, None, None),
        (9004, "same row twice over, cc by 4.0 mail a.b@example.org call +1 (555) 123-4567", "en", "s2"),
        (9004, "same row twice over, cc by 4.0 mail a.b@example.org call +1 (555) 123-4567", "en", "s2"),
        (9005, LONG, "en", "s3"),
        (9006, LONG + " and one more end.", "en", "s3"),
        (9007, "x" * 40_000, "de", "s3"),
        (9008, "three words only", "en", "s4"),
        (9009, "Three  WORDS only", "en", "s4"),
        (9010, para + PASSAGE + " tail one", "en", "s4"),
        (9011, "other lead " + PASSAGE + " " + para[:60], "en", "s5"),
        (9012, para, "en", "s5"),
        (9013, para + "plus a word", "en", "s6"),
        (9014, "line\nline\nline\n\n x \n x \n", "fr", "s6"),
        (9015, "the same eight words come again and again " * 6, "en", "s7"),
        (9016, "Größe naïve 日本語 текст mit Räumen ▁ \x00 <|endoftext|> </s> ümläut", "de", "s7"),
        (9017, "  two leading, double  spaces, trailing ", "en", "s8"),
        (9018, "4111 1111 1111 1111 and 4111-1111-1111-1112 host 10.0.0.255 1.2.3.4.5 999.1.1.1 me@x me@x.y.z @a.b +12345678 token=abcdefghijklmnop1234", "en", "s8"),
        (9019, "IBAN DE89 3704 0044 0532 0130 00 see https://example.org/a?b=c. password: hunter2hunter2hunter2", "en", "s9"),
        (9020, "released under the MIT license. All rights reserved, GENERAL public License cc-by cc by all rights reserved", "en", "s9"),
        (9021, "a b " * 500, "en", "s9"),
        (9022, " ".join([*same, one, *same, "and more of it"]) + f"\n{one}\n{other}\n", "en", "s9"),
        (9023, " ".join([*same, other, *same, "and more of it"]) + f"\n{other}\n{other}\n", "en", "s9"),
        (9024, f"{one} {one} {other}", "en", "s9"),
        (9025, f"{one} {other} {other}", "en", "s9"),
        (9026, "API_Key: abcdefghijklmnop99 HTTPS://a.example/b, Iban de89 3704 0044 0532 0130 00 tel +49 30 1234567.", "en", "s9"),
        (9028, "Notes. " + LICENSE + " The end.", "en", "s9"),
        (9029, "Notes. " + LICENSE.replace("free of charge", "at no cost at all").replace("sublicense", "lend"), "en", "s9"),
        (9030, LICENSE[:300] + " and so on", "en", "s9"),
        (9027, "http://" * 3000 + "x@" * 3000 + "1.1" * 2000, "en", "s9"),
    ]


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )


def write_documents(folder, rows: list[tuple]) -> None:
    """Rows as several files, with extra columns whose names operators use inside."""
    n = len(rows)
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([r[2] for r in rows], pa.string()),
        "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
        "row": pa.array(["clash"] * n, pa.string()),
        "hash": pa.array(["clash"] * n, pa.string()),
        "kept": pa.array([None] * n, pa.bool_()),
        **{name: pa.array(["clash"] * n, pa.string()) for name in ("s", "t", "g", "row_", "part", "tokens", "anchors", "file_", "at_", "block", "size", "surprise", "Number_")},
    }
    table = pa.table(columns)
    (folder / "documents.parquet").mkdir()
    for i in range(3):
        pq.write_table(table.slice(i * (n // 3 + 1), n // 3 + 1), folder / "documents.parquet" / f"part-{i}.parquet")


def awkward_vectors() -> list[tuple]:
    """(vec_id, embedding, label): the driver's, and nulls, odd numbers and lengths, copies, ties, large and negative ones."""
    driver = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    base = driver["embedding"][0]
    nan, inf = float("nan"), float("inf")
    odd = [(None, base, 1), (7001, None, 1), (7002, base, None), (7003, [*base[:-1], nan], 1), (7004, [inf, *base[1:]], 1), (7005, [*base[:-1], None], 1), (7006, [], 1), (7050, [], 1), (7007, base[:9], 2)]
    odd += [(7100, base, 3)] * 3 + [(7101 + i, base, 3 + i % 2) for i in range(30)] + [(7200, [-x for x in base], 3), (7250, [x * 1e4 for x in base], 4), (7251, [x * 9e3 for x in base], 4), (7252, [x * 6e3 for x in base], 5)]
    return [*zip(driver["vec_id"], driver["embedding"], driver["label"], strict=True), *odd]


def write_vectors(folder, rows: list[tuple]) -> None:
    n = len(rows)
    columns = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}
    columns |= {name: pa.array(["clash"] * n, pa.string()) for name in ("id", "row", "vector", "anchor", "cell", "group", "score", "rank")}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")


@pytest.fixture(scope="session")
def vectors() -> list[tuple]:
    return awkward_vectors()


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    driver = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return [*zip(driver["doc_id"], driver["text"], driver["lang"], driver["source"], strict=True), *awkward()]


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, rows, vectors) -> str:
    folder = tmp_path_factory.mktemp("tables")
    write_documents(folder, rows)
    write_vectors(folder, vectors)
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet"), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("empty")
    write_documents(folder, [])
    write_vectors(folder, [])
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet").slice(0, 0), folder / "benchmark.parquet")
    return str(folder)
