"""Archives written and read back, against the pages themselves."""

import gzip
import hashlib
import random

import pytest

from presssignal.llm import warc


def brute(rows):
    owners = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page_id is not None:
            owners[raw] = max(owners.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        owner = owners.get(raw) if owners.get(raw) != page_id else None
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if owner is not None else "response", owner))
    return sorted(map(repr, out))


def odd_pages():
    draw = random.Random(4)
    bits = ["\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "<p>é漢😀", "text ", "\x00", " "]
    rows = [(i, f"http://h/{i}", "".join(draw.choices(bits, k=draw.randrange(12)))) for i in range(200)]
    long = "".join(draw.choices(bits, k=3000))
    rows += [(300 + i, "http://h/ same\r\nx", long) for i in range(20)] + [(310, None, long)]
    rows += [(400, None, None), (401, "u", ""), (402, "u", None), (None, "u", "no id"), (None, "u", long), (None, "v", "z" * 2000)]
    rows += [(500, "u", "é" * 3_000_000), (501, "u", "x" * 999), (502, "u", "x" * 999), (503, "u", "x" * 1000), (504, "u", "x" * 1000), (504, "u", "x" * 1000)]
    return rows


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    pages = spark.createDataFrame(odd_pages(), "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS owner", "3 AS salt")
    return path, warc.archive_pages(pages, path, chunk_bytes=1001).collect()


def test_round_trip(archived):
    assert sorted(repr(tuple(r)) for r in archived[1]) == brute(odd_pages())


def test_payloads_come_back_in_chunks(spark, archived):
    found = {}
    for r in warc.read_chunks(spark, archived[0], keep_payload=True).orderBy("page_id", "chunk_no").collect():
        assert len(r.payload) <= 1001
        if r.page_id is not None and r.record_type == "response" and r.page_id != 504:
            so_far = found[r.page_id] = found.get(r.page_id, b"") + r.payload
            assert (len(so_far), hashlib.sha1(so_far).hexdigest()) == (r.payload_bytes, r.payload_digest)
    assert all(found[i] == (h or "").encode() for i, _, h in odd_pages() if i in found)
    assert len(found[500]) == 6_000_000


def test_files_are_archives(archived):
    import glob

    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(archived[0] + "/*.gz")))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(warc.END)
    assert sum(c[6] for c in warc.chunks([raw])) == len(odd_pages())
    assert sum(c[6] for c in warc.chunks(raw[i : i + 7] for i in range(0, len(raw), 7))) == len(odd_pages()) if len(raw) < 1 << 22 else True


def test_chunks_are_cut_between_characters():
    draw = random.Random(1)
    for _ in range(200):
        raw = "".join(draw.choices("aé漢😀", k=draw.randrange(60))).encode()
        size, at = draw.randrange(4, 20), 0
        for end in warc.chunk_ends(raw, size):
            assert end - at <= size
            raw[at:end].decode()
            at = end
        assert at == len(raw)


def test_damage_is_found():
    whole = "".join(t + "\r\n\r\n" for t in warc.records(1, "u", b"abcdefgh", 8, hashlib.sha1(b"abcdefgh").hexdigest(), None, 3)).encode()
    assert [c[3] for c in warc.chunks([whole])] == [1, 2, 3]
    for bad in (whole.replace(b"abc", b"abd"), whole.replace(b"gh\r\n", b"gx\r\n"), whole[:-20]):
        with pytest.raises(ValueError):
            list(warc.chunks([bad]))


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
