import base64
import gzip
import hashlib
import random
import time

from plumbline.llm import queries, warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    first = {}
    for k, p in rows:
        first[p] = min(k, first.get(p, k))
    out = set()
    for k, p in rows:
        revisit = len(p) >= least and first[p] != k
        out.add((k, len(p), b32(p), "revisit" if revisit else "response", first[p] if revisit else None))
    return out


def archive(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string, first int")
    warc.write(df, str(tmp_path / "a"), **options)
    return warc.read(spark, str(tmp_path / "a")).collect()


def test_round_trip_with_copies_nulls_and_odd_text(spark, tmp_path):
    rows = [(1, "u\r\nX: y", None, "", 0), (2, None, "", "", 0), (3, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>\n", "", 0), (4, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>\n", "", 0), (5, "u", "x" * 300_000, "", 0), (6, "u", " 漢\r", "", 0)]
    found = archive(spark, tmp_path, rows)
    assert not [r for r in found if r.gap] and all(r.digest_holds for r in found)
    assert {(int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in found} == expected([(k, (h or "").encode()) for k, _, h, _, _ in rows])
    kept = {int(r.record_id): r.payload for r in found if r.record_type == "response"}
    assert kept[3] == rows[2][2].encode() and kept[5] == rows[4][2].encode()


def test_small_payloads_are_never_revisited(spark, tmp_path):
    found = archive(spark, tmp_path, [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], min_bytes=3, compression="none")
    assert sorted((int(r.record_id), r.record_type) for r in found) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def records(n, member):
    return [warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>"}, f"block {i} ".encode() * 50, member) for i in range(n)]


def names(found):
    return [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]


def test_salvage_recovers_what_follows_a_broken_member():
    parts = records(5, True)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"junk" + parts[3] + parts[4][:-5]
    found = list(warc.salvage(data))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert names(found)[:2] == ["<urn:page:0>", "<urn:page:1>"] and "<urn:page:3>" in names(found)
    assert (gaps[0].start, gaps[0].end) == (len(parts[0] + parts[1]), len(parts[0] + parts[1] + parts[2]) + 4)
    assert gaps[-1].end == len(data)


def test_salvage_recovers_what_follows_a_broken_plain_record():
    parts = records(4, False)
    for damage in (parts[1].replace(b"Content-Length: ", b"Content-Length: 9"), parts[1].replace(b"block 1", b"block 7", 1), parts[1][20:], parts[1][:-30]):
        data = parts[0] + damage + parts[2] + parts[3]
        found = list(warc.salvage(data))
        assert names(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
        assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(len(parts[0]), len(parts[0]) + len(damage))]
    assert list(warc.salvage(b"")) == []


def test_salvage_of_a_damaged_start_mixed_kinds_and_adjacent_broken_members():
    parts = records(5, True)
    data = b"\0" * 100 + parts[0][100:] + b"".join(parts[1:])
    found = list(warc.salvage(data))
    assert names(found) == [f"<urn:page:{i}>" for i in range(1, 5)]
    assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(0, len(parts[0]))]
    plain = records(4, False)
    assert names(warc.salvage(plain[0] + plain[1] + parts[2] + plain[3] + parts[4])) == [f"<urn:page:{i}>" for i in range(5)]

    def broken(i):  # two records in a member, the second cut off
        noise = bytes(random.Random(i).randbytes(30_000))
        raw = warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>"}, b"head") + warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:99>"}, noise)
        return gzip.compress(raw)[:20_000]

    assert names(warc.salvage(broken(10) + broken(11) + parts[0])) == ["<urn:page:10>", "<urn:page:11>", "<urn:page:0>"]


def test_query_over_the_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = queries.QUERIES["op10_warc"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    assert {tuple(r) for r in rows} == expected([(p.page_id, (p.html or "").encode()) for p in pages])


def test_damage_in_a_written_archive_costs_one_record(spark, tmp_path):
    rows = [(i, "u", f"page {i} " + str(random.Random(i).random()) * 40, "", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string, first int").coalesce(1)
    warc.write(df, str(tmp_path / "a"))
    file = max((tmp_path / "a").glob("part-*"), key=lambda f: f.stat().st_size)
    whole = file.read_bytes()
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 300
    held = [x for x in warc.salvage(whole)]
    hit = held[30]
    broken = bytearray(whole)
    broken[hit.offset + hit.length // 2] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert names(found) == [n for i, n in enumerate(names(held)) if i != 30]
    assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(hit.offset, hit.offset + hit.length)]


def test_a_record_of_16_mb_and_an_empty_member(spark, tmp_path):
    rows = [(1, "u", "x" * (17 << 20), "", 0), (2, "u", "y", "", 0)]
    found = archive(spark, tmp_path, rows)
    assert sorted((r.record_id, r.payload_bytes, r.gap) for r in found) == [("1", 17 << 20, None), ("2", 1, None)]


def test_gaps_start_behind_what_a_broken_member_gave():
    heads = [warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>"}, random.Random(i).randbytes(3000)) for i in range(4)]
    packed = gzip.compress(b"".join(heads))
    damaged = bytearray(packed)
    damaged[len(packed) * 5 // 8] ^= 0xFF
    parts = records(2, True)
    data = parts[0] + bytes(damaged) + parts[1]
    found = list(warc.salvage(data))
    assert names(found)[:3] == ["<urn:page:0>", "<urn:page:0>", "<urn:page:1>"] and names(found)[-1] == "<urn:page:1>"
    gap = next(x for x in found if isinstance(x, warc.Gap))
    assert len(parts[0]) + 6000 < gap.start < gap.end == len(parts[0]) + len(packed)


def test_time_grows_with_the_bytes():
    def seconds(n):
        part = warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:1>"}, random.Random(1).randbytes(20_000), True)
        began = time.process_time()
        assert len(list(warc.salvage(part * n))) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(2000) < 8 * seconds(500)
