import datetime
import posixpath
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import images, layout
from gleaner.operators import moves
from gleaner.sources import readers
from gleaner.streaming import stateful

NOW = datetime.datetime(2024, 1, 20)
FILES = "source string, folder string, name string"


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (99).to_bytes(4, "big")
    frame = b"\xff\xc0\0\x11\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + b"\x03"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc4\0\x03c" + frame
    far = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"\xc0" * 65533) * 5 + frame
    made = {
        "png": (png, "png", 640, 99, False), "cut png": (png[:22], "png", 640, None, False), "cut large png": (png[:22] + b"", "png", 640, None, False),
        "gif": (b"GIF87a" + bytes([44, 1, 100, 0]), "gif", 300, 100, True), "jpeg": (jpeg, "jpeg", 400, 300, True), "far": (far, "jpeg", 400, 300, True),
        "cut jpeg": (jpeg[:-4], "jpeg", None, None, False), "pixels first": (b"\xff\xd8\xff\xda\0\x02" + frame, "jpeg", None, None, False), "bad length": (b"\xff\xd8\xff\xe0\0\x01" + frame, "jpeg", None, None, False),
        "webp without frame": (b"RIFF\0\0\0\0WEBPVP8 " + bytes(14), "webp", None, None, False), "no image, but large": (b"x" * 5000, None, None, None, True), "small": (b"x" * 4999, None, None, None, False),
        "empty": (b"", None, None, None, False), "null": (None, None, None, None, False),
    }
    rows = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in made.items()], "name string, content binary")
    size = images.image_size(F.col("content"))
    for r in rows.select("name", images.image_kind(F.col("content")).alias("kind"), size.alias("size"), images.image_ok(F.col("content"), size).alias("ok")).collect():
        assert (r.kind, r.size.width, r.size.height, r.ok) == made[r.name][1:], r.name


CODE = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")


def wide(c):
    return 2 if unicodedata.east_asian_width(c) in "FW" else 1


def greedy(text, width, prefix):
    """One character after the other."""
    lines, now, used, any_yet = [], "", 0, False
    i = 0
    while i < len(text):
        code = CODE.match(text, i)
        if code:
            now, i = now + code.group(), code.end()
            continue
        if any_yet and used + wide(text[i]) > width:
            lines.append(now)
            now, used, any_yet = prefix, sum(map(wide, prefix)), False
        now, used, any_yet, i = now + text[i], used + wide(text[i]), True, i + 1
    return lines + [now]


def test_wrapped_and_fitted(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(["a", "b ", "码", "宽", "\x1b[31m", "\x1b[0m", "\n", "é"]) for _ in range(dice.randrange(60))) for _ in range(300)]
    texts += ["", "\x1b[31m", "码", "x" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for width, prefix in ((7, "> "), (1, ""), (3, "码码"), (10, "")):
        for r in rows.select("t", layout.wrapped(F.col("t"), width, prefix).alias("x"), layout.fitted(F.col("t"), width).alias("f")).collect():
            if r.t is None:
                assert r.x is None and r.f is None
                continue
            assert r.x == greedy(r.t, width, prefix), (r.t, width)
            bare = CODE.sub("", r.f)
            assert sum(map(wide, bare)) == width
            if sum(map(wide, CODE.sub("", r.t))) > width:
                shown = bare.rstrip(" ")
                assert shown.endswith("…") and CODE.sub("", r.t).startswith(shown[:-1])
            else:
                assert r.f.startswith(r.t)


def test_paths(spark):
    paths = ["/a/b/../c", "/../x", "a/./b//c", "../a", "a/../..", "a/../../b", "", "/", ".", "/a/..", "..", "/vault/x.md", "/vaults/x.md", "x.md", "../vaults/x.md", "/vault/../vault/y.MD", "/vault/.md", "/vault", "sub/已读/z.md", None]
    rows = {r.p: r for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", moves.normal_path(F.col("p")).alias("n"), moves.path_below(F.col("p"), "/vault/").alias("b"), moves.path_below(F.col("p"), "/vault", ".md", absolute=False).alias("m")).withColumn("r", moves.in_folder(F.col("b"), "/vault", ["已读"])).collect()}
    for p in paths:
        if p is not None:
            assert rows[p].n == posixpath.normpath(p), p
            inside = posixpath.normpath(posixpath.join("/vault", p))
            assert rows[p].b == (inside if p and (inside + "/").startswith("/vault/") else None), p
    assert rows[None].n is None and rows[None].b is None and rows[None].r is False
    assert {p for p in paths if rows[p].m} == {"x.md", "sub/已读/z.md"} and {p for p in paths if rows[p].r} == {"sub/已读/z.md"}
    at_root = spark.range(1).select(moves.path_below(F.lit("a/../b"), "/").alias("x")).first().x
    assert at_root == "/b"


def plain_plan(wanted, existing):
    """The rule, one file after the other."""
    taken, out, later = set(existing), {}, []
    for source, folder, name in sorted(wanted):
        if (folder, name) in taken:
            later.append((source, folder, name))
        else:
            taken.add((folder, name))
            out[source] = (folder, name)
    for source, folder, name in later:
        cut = re.match(r"(?s)^(.+)(\.(?!_[1-9][0-9]*$)[^.]+)$", name)
        stem, suffix = cut.groups() if cut else (name, "")
        k = 1
        while (folder, f"{stem}_{k}{suffix}") in taken:
            k += 1
        taken.add((folder, f"{stem}_{k}{suffix}"))
        out[source] = (folder, f"{stem}_{k}{suffix}")
    return out


def test_free_names(spark):
    dice = random.Random(3)
    names = ["a.md", "a_1.md", "a_2.md", "a_1_1.md", "b", "b_1", ".x", "a.", "a._1", "a._2", "a_01.md", "a_99999999999999999999.md", "长.tar.gz", "a b.md"]
    wanted = [(f"s{i:04d}", f"/f{dice.randrange(2)}", dice.choice(names)) for i in range(150)] + [(f"h{i:04d}", "/hot", "same.md") for i in range(400)]
    existing = [(f"/f{dice.randrange(2)}", dice.choice(names)) for _ in range(20)] + [("/hot", f"same_{k}.md") for k in (1, 2, 5, 9, 300, 900)] * 2
    got = moves.free_names_for(spark.createDataFrame(wanted, FILES), spark.createDataFrame(existing, "folder string, name string")).collect()
    assert {r.source: (r.folder, r.free) for r in got} == plain_plan(wanted, existing) and len(got) == len(wanted)
    assert moves.free_names_for(spark.createDataFrame([], FILES), spark.createDataFrame(existing, "folder string, name string")).count() == 0


def test_plan_is_replayed(spark):
    shape = "path string, modified timestamp, category string, item_type string, source string, _rank int"
    files = spark.createDataFrame([("/in/1/a.md", NOW, "memo", "md", "x", 1), ("/in/2/a.md", None, "memo", "md", None, 2), ("/in/2/a.md", None, "memo", "md", None, 2), ("/in/3/a.md", NOW, "..", None, "", 3), (None, NOW, "c", "d", "", 4)], shape)
    none = spark.createDataFrame([], "source string, destination string, moved_at timestamp")
    there = spark.createDataFrame([("/bin/memo/md/20240120/a_1.md",), (None,)], "path string")
    plan = moves.recycled(files, there, none, "/bin/", F.lit(NOW))
    got = {r.source: r.destination for r in plan.collect()}
    assert got == {"/in/1/a.md": "/bin/memo/md/20240120/a.md", "/in/2/a.md": "/bin/memo/md/20240120/a_2.md", "/in/3/a.md": "/bin/_/unknown/20240120/a.md"}
    assert moves.recycled(files, there, plan, "/bin", F.lit(NOW)).count() == 0
    back = files.limit(1).withColumn("modified", F.lit(NOW + datetime.timedelta(days=1)))
    again = moves.recycled(back, there, plan, "/bin", F.lit(NOW)).collect()
    assert [r.destination for r in again] == ["/bin/memo/md/20240120/a_3.md"]


def test_archive(spark):
    read, unread = "- [x] **是否已读**\n", "- [ ] **是否已读**\n"
    notes = spark.createDataFrame([("/v/memo/a.md", None, read), ("/v/else/a.md", None, read), ("/v/memo/b.md", None, unread), ("/v/memo/c.txt", None, read), ("/v/memo/d.md", None, None)], "path string, modified timestamp, text string")
    none = spark.createDataFrame([], "source string, destination string, moved_at timestamp")
    there = spark.createDataFrame([("/v/已读/memo/a.md",)], "path string")
    got = {r.source: r.destination for r in moves.archived(notes, there, none, "/v", ["memo", "digest"], F.lit(NOW)).collect()}
    assert got == {"/v/memo/a.md": "/v/已读/memo/a_1.md", "/v/else/a.md": "/v/已读/digest/a.md"}


def test_torn_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    default = spark.createDataFrame([(0,)], "n int")
    assert readers.latest_version(spark, path, default).first().n == 0
    with pytest.raises(FileNotFoundError):
        readers.latest_version(spark, path)
    for n in range(1, 5):
        readers.write_versioned(spark.createDataFrame([(n,)], "n int"), path, n)
    assert readers.latest_version(spark, path).first().n == 4
    (tmp_path / "state/v=00000004/_COMPLETE").unlink()
    assert readers.latest_version(spark, path).first().n == 3
    next((tmp_path / "state/v=00000003").glob("part-*.parquet")).unlink()
    assert readers.latest_version(spark, path).first().n == 2
    with pytest.raises(ValueError):
        readers.read_version(spark, path, 3)
    readers.write_versioned(spark.createDataFrame([(5,)], "n int"), path, 4)
    assert readers.latest_version(spark, path).first().n == 5


def test_daily_quota(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 3, day, hour, 30)
    batches = [
        [(1, "view", at(1, 9)), (1, "error", at(1, 10)), (2, "view", at(1, 23)), (None, "view", at(1, 9)), (1, "view", None)],
        [(1, "view", at(1, 23)), (1, "view", at(1, 23)), (1, "view", at(2, 1)), (2, None, at(2, 0))],
        [(1, "view", at(1, 12)), (2, "error", at(3, 2))],  # the first one's day is closed
    ]
    (tmp_path / "in").mkdir()
    schema = "user_id long, event_type string, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    out = {}
    with stateful.many_states(spark):
        for i in range(len(batches)):  # the stream starts anew from its checkpoint each time
            folder = str(tmp_path / "in") + ("/[0-%d]" % i)
            stream = spark.readStream.schema(schema).parquet(folder)
            for r in stateful.last_states(stateful.daily_quota(stream, 2), ["user_id", "day"], str(tmp_path / "out"), str(tmp_path / "ck")).collect():
                out[r.user_id, r.day.day] = (r.used, r.errors, r.remaining, r.open)
    assert out == {(1, 1): (3, 1, 0, False), (2, 1): (1, 0, 1, False), (1, 2): (1, 0, 1, False), (2, 2): (1, 0, 1, False), (2, 3): (0, 1, 2, True)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_daily_quota_asks_its_store_a_few_times_a_user():
    """calls of the state's store don't grow with a user's days; an earlier day that comes later gets its own midnight."""
    from types import SimpleNamespace

    import pandas as pd

    calls, timers, kept = [], [], []
    value = SimpleNamespace(
        get=lambda: calls.append("get") or (kept[-1] if kept else None), update=lambda v: calls.append("update") or kept.append(v), clear=lambda: calls.append("clear") or kept.clear()
    )
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda at: calls.append("timer") or timers.append(at))
    quota = stateful.DailyQuota(3)
    quota.init(handle)
    day = stateful.DAY_MS
    rows = lambda days: iter([pd.DataFrame({"day": days, "used": [1] * len(days), "errors": [2] * len(days)})])
    assert len(pd.concat(quota.handleInputRows((7,), rows(list(range(10, 110))), None))) == 100
    assert calls == ["get", "update", "timer"] and timers == [11 * day]
    assert len(pd.concat(quota.handleInputRows((7,), rows([5, 10]), None))) == 2 and timers[-1] == 6 * day
    fired = lambda at, mark: list(quota.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    calls.clear()
    closed = pd.concat(fired(6 * day, 100 * day))
    assert len(closed) == 91 and not closed["open"].any() and calls == ["get", "update", "timer"] and timers[-1] == 101 * day
    assert closed.set_index("used").loc[2, "remaining"] == 1 and fired(11 * day, 100 * day) == []
    assert len(pd.concat(fired(101 * day, 200 * day))) == 10 and calls[-1] == "clear"
