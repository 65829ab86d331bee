"""The data source of pages beside the reader of whole files."""

import pytest
from pyspark.sql import functions as F

from inkdiff.compare import compare
from inkdiff.sources import pages, pdf

PAGE = b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj << %s >> stream\n%s\nendstream endobj\n"


def files(folder):
    long = b"%PDF-1.4\n" + b"".join(PAGE % (2 * k, 2 * k + 1, 2 * k + 1, b"/Filter /FlateDecode" if k == 7 else b"", b"BT (Page %d of the long one) Tj ET" % k) for k in range(1, 41))
    (folder / "long.pdf").write_bytes(long)
    for name, text in (("a", b"1. Scope of the policy for all"), ("b", b"1. Scope of the policy for most")):
        (folder / f"{name}.pdf").write_bytes(b"%PDF-1.4\n" + PAGE % (1, 2, 2, b"", b"BT (%s) Tj ET" % text))
    (folder / "broken.pdf").write_bytes(b"nothing at all")
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "no_extension").write_bytes(b"%PDF-1.4\n")
    return len(long)


def as_rows(df):
    return sorted(((r["document_id"], r["document_name"], r["version"], r["page_number"], r["original_text"], r["ocr_warning"], tuple(r["errors"])) for r in df.collect()), key=repr)


def test_the_same_rows_as_whole_files(spark, tmp_path):
    size = files(tmp_path)
    whole = as_rows(pdf.read_pages(spark, str(tmp_path), version="v"))
    assert len(whole) == 43 and sum(bool(r[-1]) for r in whole) == 2
    whole = sorted([*whole, ("empty", "empty.pdf", "v", None, "", True, ("not a PDF file",))], key=repr)  # Spark's file reader leaves it out
    for part in (pages.PART, size // 4, 1):
        found = pages.document_pages(spark, str(tmp_path), version="v", part_bytes=part)
        assert found.dtypes == pdf.read_pages(spark, str(tmp_path)).dtypes
        assert as_rows(found) == whole
    split = pages.document_pages(spark, str(tmp_path), part_bytes=size // 4).where("document_id = 'long' and page_number is not null").select(F.spark_partition_id().alias("p")).distinct()
    assert split.count() >= 4
    assert as_rows(pages.document_pages(spark, f"{tmp_path}/[ab].pdf", version="v")) == [r for r in whole if r[0] in "ab"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pages.document_pages(spark, f"{tmp_path}/none").collect()


def test_pages_of_the_source_are_compared(spark, tmp_path):
    files(tmp_path)
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "a", "broken")], "pair_id string, document_id_a string, document_id_b string")
    out = compare(pages.document_pages(spark, str(tmp_path)), pairs)
    status = {r["pair_id"]: (r["processing_complete"], r["errors"]) for r in out["status"].collect()}
    assert status == {"p": (True, []), "q": (False, ["not a PDF file"])}
    assert {r["pair_id"]: r["change_type"] for r in out["rows"].collect()} == {"p": "wording_only", "q": "removed"}
