"""The encoding of a delimited file is that of all its lines."""

from assayer.sources.datasets import SNIFFED, read_delimited


def test_a_late_byte_decides(spark, tmp_path):
    rows = [f"{i};plain" for i in range(SNIFFED // 5)]
    late = tmp_path / "late.csv"
    late.write_bytes("\n".join(["id;word", *rows, "9;café"]).encode("latin-1"))
    assert read_delimited(spark, str(late)).where("word <> 'plain'").collect()[0].word == "café"
    utf = tmp_path / "utf.csv"
    utf.write_text("\n".join(["id;word", *rows, "9;café �"]), encoding="utf-8")
    assert read_delimited(spark, str(utf)).where("word <> 'plain'").collect()[0].word == "café �"
