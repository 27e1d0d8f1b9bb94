import hashlib
import io
import zlib

from stallwise.llm import warc


def member(i, size=300, plain=False):
    payload = (f"page {i} " * size).encode()
    raw = warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None, False)
    if plain:
        return raw
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def salvaged(data, step=None):
    stream = io.BytesIO(data)
    read = stream.read if step is None else lambda n: stream.read(step)
    out = list(warc.salvage(read))
    return [int(x[3]["page-id"]) for x in out if x[0] == "record"], [(x[1], x[2]) for x in out if x[0] == "gap"]


def test_sound_archives_of_both_kinds():
    for plain in (False, True):
        parts = [member(i, 1 + 50 * i, plain) for i in range(12)]
        for step in (None, 7, 1000):
            ids, gaps = salvaged(b"".join(parts), step)
            assert ids == list(range(12)) and gaps == []
    assert salvaged(b"") == ([], [])


def test_damage_is_skipped_and_logged():
    for plain in (False, True):
        parts = [member(i, 60, plain) for i in range(10)]
        at = [sum(map(len, parts[:i])) for i in range(11)]
        data = bytearray(b"".join(parts))
        middle = (at[3] + at[4]) // 2
        data[middle:middle + 20] = b"\xff" * 20  # damaged inside
        data[at[6]:at[6] + 4] = b"\0" * 4  # no start
        ids, gaps = salvaged(bytes(data))
        assert ids == [0, 1, 2, 4, 5, 7, 8, 9]
        assert gaps == [(at[3], at[4]), (at[6], at[7])]
        junk = b"lost " * 9 + bytes(data[:at[3]]) + b"\x1f\x8b\x08 no member WARC/1.1 no record" + bytes(data[at[7]:-30])
        ids, gaps = salvaged(junk)
        assert ids == [0, 1, 2, 7, 8] and len(gaps) == 3 and gaps[0] == (0, 45) and gaps[2][1] == len(junk)


def test_every_single_damaged_byte_costs_one_record():
    parts = [member(i, 3) for i in range(3)]
    whole = b"".join(parts)
    for at in range(len(parts[0]), len(parts[0]) + len(parts[1])):
        data = bytearray(whole)
        data[at] ^= 0x55
        ids, gaps = salvaged(bytes(data))
        assert {0, 2} <= set(ids) and (ids == [0, 2]) == bool(gaps)


def test_round_trip_with_revisits(spark):
    big, small = "é" * 700, "s" * 900
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (7, "u", small), (8, "u", small), (9, "u\r\nX: y", None), (None, "n", big),
            (10, "u", ""), (5, "http://b", big), (11, "u", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'x' as kept")
    got = warc.round_trip(spark, pages).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    seen = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=str)
    text = {1: big, 5: big, 3: big, 0: big, 7: small, 8: small, 9: "", 10: "", 11: "x" * 300000}
    for i, kind, refers, n, digest in seen:
        assert n == len(text[i].encode()) and digest == hashlib.sha1(text[i].encode()).hexdigest()
        assert (kind, refers) == (("revisit", 5) if i in (0, 1, 3) else ("response", None))
    stored = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert stored[11] == b"x" * 300000 and stored[9] == b""
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_salvage_through_spark(spark, tmp_path):
    parts = [member(i, 40) for i in range(6)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2] + parts[3])
    (tmp_path / "b.warc").write_bytes(member(4, 40, True) + b"rubbish" + member(5, 40, True))
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),), (f"file://{tmp_path}/b.warc",)], "path string")
    got = warc.read_archives(archives).collect()
    assert sorted(r.page_id for r in got if r.kind == "record") == [0, 2, 3, 4, 5]
    assert sorted(r.end - r.start for r in got if r.kind == "gap") == sorted([len(parts[1]) - 9, 7])
