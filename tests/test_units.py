"""Small cases with results worked out by hand."""

import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F

from medialake.functions import classify, paths
from medialake.functions import values as val
from medialake.operators import collections, identity, infer, merge, normalise, plays, scan, search, shelves, sidecars
from medialake.sources.catalog import Catalog
from medialake.sources.extractors import Extractors
from medialake.sources.files import hash_files, list_inventory
from medialake.sources.scratch import scratch


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_paths(spark):
    lit = F.lit
    assert one(spark, paths.extension_of(lit("/a/b.MP3"))) == "mp3"
    assert one(spark, paths.extension_of(lit("/a/.hidden"))) == ""
    assert one(spark, paths.stem(lit("/a/.hidden"))) == ".hidden"
    assert one(spark, paths.dirname(lit("/a"))) == "/"
    assert one(spark, paths.is_within(lit("/music"), lit("/music/a"))) and not one(spark, paths.is_within(lit("/music"), lit("/musical/b"))) and not one(spark, paths.is_within(lit("/music"), lit("/music")))
    assert one(spark, paths.ancestors(lit("/a/b/c.mp3"))) == ["/a", "/a/b"]
    assert one(spark, paths.hidden_below(lit("/a/.x"), lit("/a/.x/b"))) is False


def test_headers_outvote_extensions(spark):
    kind = lambda path, head: one(spark, classify.classify(F.lit(path), F.unhex(F.lit(head))))
    assert kind("a.txt", "4944330300") == "audio"
    assert kind("a.mp3", "424D1234567800000000") == "image"
    assert kind("a.mka", "1A45DFA3" + "0" * 8 + "4282886D6174726F736B61") == "audio"
    assert kind("a.mka", "1A45DFA3" + "0" * 8 + "4282847765626D") == "video"
    assert kind("a.m4a", "00000020667479706D703432") == "audio"
    assert kind("a.mp3", "000000") == "audio"


def test_sidecars(spark):
    media = spark.createDataFrame([("/d/Episode.mkv",), ("/d/Episode.en.mkv",), ("/d/Song.flac",), ("/d/Song.mp3",), ("/e/Episode.mkv",), ("/d/Other.mkv",)], "path string")
    others = spark.createDataFrame([("/d/Episode.en.srt",), ("/d/Episode.de.srt",), ("/d/Song.lrc",), ("/d/Episodes.srt",), ("/e/COVER.jpg",), ("/d/notes.doc",)], "path string")
    got = {(r.media_path, r.sidecar_path, r.kind) for r in sidecars.associate(media, others).collect()}
    assert got == {
        ("/d/Episode.en.mkv", "/d/Episode.en.srt", "subtitles"), ("/d/Episode.mkv", "/d/Episode.de.srt", "subtitles"), ("/d/Song.flac", "/d/Song.lrc", "lyrics"), ("/d/Song.mp3", "/d/Song.lrc", "lyrics"), ("/e/Episode.mkv", "/e/COVER.jpg", "artwork"),
    }


def test_names(spark):
    rows = [("/tv/Fixture Show S01E02.mkv", None), ("/tv/Cool Show (2020) - S01E02.mkv", "Cool.Show.S01E02.1080p.WEB-DL"), ("/tv/Show/Season 2/S02E03 - Title.mkv", None), ("/f/Film 1920x1080.mp4", None), ("/f/Film (1999).mp4", "Given"), ("/f/Film (1999)/movie.mp4", None)]
    got = [tuple(r) for r in infer.infer_from_path(spark.createDataFrame(rows, "path string, title string")).select("series", "season", "episode", "year", "title", "tagged_title").collect()]
    assert got == [
        ("Fixture Show", 1, 2, None, None, None), ("Cool Show", 1, 2, 2020, "Cool Show (2020) - S01E02", "Cool.Show.S01E02.1080p.WEB-DL"), ("Show", 2, 3, None, "Title", None), (None, None, None, None, None, None), (None, None, None, 1999, "Given", None), (None, None, None, 1999, None, None),
    ]


def test_values(spark):
    assert one(spark, val.decibels(F.lit("−6.20 dB"))) == -6.2
    assert one(spark, val.pdf_date(F.lit("D:202301020304Z"))) == "2023-01-02T03:04Z"
    assert one(spark, val.pdf_date(F.lit("2023"))) is None
    assert one(spark, val.isbn(F.lit("urn:isbn:978-3-16-148410-0"))) == "9783161484100"
    assert one(spark, val.clock_text(F.lit(3_723_000))) == "62:03"
    assert one(spark, val.degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("West"), "W")) == -10.5
    assert one(spark, val.exif_time(F.lit("0000:00:00 00:00:00"))) is None
    assert one(spark, val.distinct_names(F.array(F.lit("b"), F.lit(" "), F.lit("a "), F.lit("b")))) == ["b", "a"]


def test_merge(spark):
    files = spark.createDataFrame([("f",), ("g",)], "file_id string")
    tiers = spark.createDataFrame([("f", 2, "late", ["x"], {"a": "2", "b": "2"}), ("f", 1, "", [], {"a": "1"})], "file_id string, tier int, title string, genres array<string>, extra map<string,string>")
    got = {r.file_id: r for r in merge.merge_tiers(files, tiers).collect()}
    assert got["f"].title == "late" and got["f"].genres == ["x"] and got["f"].extra == {"a": "1", "b": "2"}
    assert got["g"].title is None


def test_tags_first_value_wins(spark):
    rows = [("f", "vorbis", 1, "MUSICBRAINZ_ALBUMID", "m1"), ("f", "vorbis", 2, "MusicBrainz Album Id", "m2"), ("f", "vorbis", 3, "odd", "1"), ("f", "vorbis", 4, "odd", "2"), ("f", "vorbis", 5, "genre", "Rock"), ("f", "vorbis", 6, "genre", "Pop"), ("f", "vorbis", 7, "track", "3/8"), ("f", "id3v1", 0, "title", "old"), ("f", "vorbis", 9, "title", "new"), ("f", "vorbis", 10, "artist", "  ")]
    r = normalise.normalise_tags(spark.createDataFrame(rows, "file_id string, dialect string, seq int, key string, value string")).first()
    assert (r.release_id, r.title, r.genres, r.track_number, r.track_total, r.artist) == ("m1", "new", ["Rock", "Pop"], 3, 8, None)
    assert r.extra == {"MUSICBRAINZ_ALBUMID": '"m1"', "MusicBrainz Album Id": '"m2"', "odd": '["1","2"]'}


def test_rescan_of_the_same_inventory_changes_nothing(spark):
    known = spark.createDataFrame([("/a.mp3", 1, 5, 100, 1)], "path string, file_id long, size_bytes long, modified_s long, scanned_s long")
    hashes = spark.createDataFrame([(1, "sha256", "h")], "file_id long, kind string, value string")
    nothing = spark.createDataFrame([], "path string, size_bytes long, modified_ms long, stage string")
    got = scan.diff(known, known.select("path", "size_bytes", "modified_s"), hashes, nothing).first()
    assert got.status == "unchanged"
    assert scan.diff(known, known.select("path", "size_bytes", "modified_s"), hashes.limit(0), nothing).first().status == "changed"


def test_moves_and_copies(spark):
    new = spark.createDataFrame([("/b.mp3", "h"), ("/c.mp3", "h"), ("/d.mp3", "g")], "path string, value string")
    gone = spark.createDataFrame([(1, "/a.mp3", "h"), (2, "/z.mp3", "g")], "file_id long, path string, value string")
    listing = spark.createDataFrame([("/b.mp3",), ("/c.mp3",), ("/d.mp3",), ("/z.mp3",)], "path string")
    assert [tuple(r) for r in scan.recognise_moves(new, gone, listing).collect()] == [("/b.mp3", 1, "/a.mp3")]


def test_shelf_counts_nulls_three_ways(spark):
    t = spark.createDataFrame([(1, None, "x", None, 5, 1), (2, "A", "x", None, None, 1), (3, "A", None, "y", 7, 1)], "n int, album string, artist string, album_artist string, duration_ms long, year int")
    assert shelves.music_summary(t).first().albums == 2
    assert {r.artist: r.albums for r in shelves.artists(t).collect()} == {"x": 1, "Unknown": 0 + 1}
    assert {r.album for r in shelves.artist_detail(t, "x").collect()} == {"Unknown", "A"}
    first = {r.album: r.artist for r in shelves.albums(t, ("n",)).collect()}
    assert first == {"Unknown": "x", "A": "x"}
    assert [r.n for r in shelves.sort_shelf(t, {"time": F.col("duration_ms")}, ("n",), "time", False).collect()] == [3, 1, 2]
    assert [r.n for r in shelves.sort_shelf(t, {"time": F.col("duration_ms")}, ("n",), "time", True).collect()] == [1, 3, 2]


def test_search(spark):
    items = spark.createDataFrame([(1, "Sign-On Café", ["rock"]), (2, "Signal on", []), (3, None, None)], "item_id long, title string, tags array<string>")
    index = search.build_index(items, ["title", "tags"])
    ids = lambda q: [r.item_id for r in search.search(index, q).collect()]
    assert ids("sign-on") == [1] and sorted(ids("sig")) == [1, 2] and ids("cafe ro") == [1] and ids('"') == [] and ids("stranger") == []
    again = search.update_index(search.build_index(items.where("item_id > 1"), ["title", "tags"]), items.where("item_id = 1"), ["title", "tags"])
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))


def test_collections(spark):
    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "collection_id long, position long, item_id string")
    order = lambda df: [r.item_id for r in df.orderBy("position").collect()]
    to = lambda a, b: spark.createDataFrame([(1, a, b)], "collection_id long, source long, target long")
    assert order(collections.move(e, to(0, 2))) == ["b", "c", "a"]
    assert order(collections.move(e, to(2, 0))) == ["c", "a", "b"]
    extra = spark.createDataFrame([(1, 0, "c"), (1, 1, "d"), (1, 2, "d")], "collection_id long, position long, item_id string")
    assert order(collections.append_entries(e, extra)) == ["a", "b", "c", "d", "d"]
    assert order(collections.union_once(collections.append_entries(e, extra))) == ["a", "b", "c", "d"]


def test_chapters(spark):
    log = spark.createDataFrame([("x", 6000), ("x", 12000), ("y", 5)], "item_id string, position_ms long")
    marks = spark.createDataFrame([("x", 0), ("x", 5000), ("x", 7000)], "item_id string, start_ms long")
    got = {(r.item_id, r.position_ms): (r.chapter_ms, r.next_ms, r.previous_ms) for r in plays.locate_chapter(log, marks).collect()}
    assert got == {("x", 6000): (5000, None, 0), ("x", 12000): (7000, None, 7000), ("y", 5): (None, None, 0)}


def test_listing_and_hashing_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    big = os.urandom(5000)
    for name, data in (("a.mp3", b"abc"), ("_intro.mp3", b""), ("sub/c.mp4", big), (".x.mp3", b"1"), (".hidden/d.mp3", b"1")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.mp3").symlink_to(tmp_path / "a.mp3")
    roots = spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "gone"),)], "root string")
    listed = list_inventory(roots).collect()
    assert {r.path.removeprefix(f"{tmp_path}/") for r in listed if r.entry_type == "file"} == {"a.mp3", "_intro.mp3", "sub/c.mp4"}
    assert [r.path for r in listed if r.error] == [str(tmp_path / "gone")]
    files = list_inventory(roots).where("entry_type = 'file'")
    got = {r.path: (r.value, r.error) for r in hash_files(files, span=1000).collect()}
    assert got[str(tmp_path / "sub/c.mp4")][0] == hashlib.sha256(big[:1000] + big[-1000:] + (5000).to_bytes(8, "little")).hexdigest()
    as_column = spark.createDataFrame([(bytearray(big),)], "c binary").select(identity.sampled_sha256(F.col("c"), 1000).alias("x")).first()["x"]
    assert as_column == got[str(tmp_path / "sub/c.mp4")][0]
    assert "changed" in hash_files(files.withColumn("size_bytes", F.col("size_bytes") + 1)).first().error


def test_catalog_commits_are_whole(spark):
    catalog = Catalog(spark, scratch(spark, "test-catalog"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert catalog.commit({"files": rows, "tags": rows}) == 1
    assert catalog.commit({"files": rows.where("id = 1").union(spark.createDataFrame([(3, "c")], "id long, x string"))}) == 2
    assert catalog.read("tags").count() == 2 and catalog.read("files", 1).count() == 2
    assert {(r.id, r.change) for r in catalog.changes("files", "id", 1, 2).collect()} == {(2, "removed"), (3, "added")}


def test_extractors(spark):
    known = Extractors()
    say = lambda text: lambda it: (pd.DataFrame({"file_id": d.file_id, "title": text}) for d in it)
    known.register("late", ("audio", "video"), (), say("late"), 2)
    known.register("early", ("audio",), ("mp3",), say("early"), 1)
    files = spark.createDataFrame([("1", "/a.mp3", "audio"), ("2", "/b.mkv", "video"), ("3", "/c.pdf", "document")], "file_id string, path string, kind string")
    got = {r.file_id: r.title for r in merge.merge_tiers(files.select("file_id"), known.tiers(files, "title string")).collect()}
    assert got == {"1": "early", "2": "late", "3": None}


def test_renderer_failures_give_no_row(spark):
    from medialake.sources.extractors import render_thumbnails

    rows = spark.createDataFrame([(1, bytearray(b"good")), (2, bytearray(b"bad")), (3, bytearray(b""))], "file_id long, data binary")

    def render(data, longest):
        if data == b"bad":
            raise ValueError
        return data[:2] or None

    assert [(r.file_id, bytes(r.data), r.role) for r in render_thumbnails(rows, render).collect()] == [(1, b"go", "thumbnail")]


def test_streams_agree_with_batches(spark):
    """Bursts of folder changes: the last one waits for a later event."""
    from medialake.sources.scratch import scratch
    from medialake.streaming import jobs

    path = scratch(spark, "bursts")
    rows = [(1, "/m/a", "2024-01-01 00:00:00"), (1, "/m/b", "2024-01-01 00:00:01"), (1, "/m/c", "2024-01-01 00:00:30"), (2, "/m/z", "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "library_id long, dir string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(path)
    out = scratch(spark, "bursts-out")
    jobs.collected(jobs.debounced_dirs(spark.readStream.schema(df.schema).parquet(path)), out, scratch(spark, "bursts-state"), "append")
    got = sorted((r.library_id, sorted(r.dirs)) for r in spark.read.parquet(f"{out}/*").collect())
    assert got == [(1, ["/m/a", "/m/b"]), (1, ["/m/c"])]


def test_a_failing_extractor_costs_no_other_its_rows(spark):
    def picky(batches):
        for df in batches:
            if (df.path == "/b.mp3").any():
                raise ValueError("broken file")
            yield df[["file_id"]].assign(title="t")

    known = Extractors()
    files = spark.createDataFrame([(i, f"/{x}.mp3", "audio") for i, x in enumerate("abc")], "file_id long, path string, kind string")
    assert known.tiers(files, "title string").count() == 0
    known.register("picky", ("audio",), (), picky, 1)
    known.register("other", ("audio",), (), lambda batches: (df[["file_id"]].assign(title="o") for df in batches), 2)
    got = known.tiers(files, "title string")
    assert sorted((r.file_id, r.tier) for r in got.collect()) == [(0, 1), (0, 2), (1, 2), (2, 1), (2, 2)] and dict(got.dtypes)["file_id"] == "bigint"


def test_hooks_of_a_scan(spark):
    """A path in two libraries, a returned file that changed, an unsafe folder, hooks, and an observer that fails."""
    from medialake.operators import full_scan

    listing = spark.createDataFrame([("/m/a.mp3", "audio", 5, 9), ("/m/b.srt", None, 1, 9)], "path string, kind string, size_bytes long, modified_s long")
    roots = spark.createDataFrame([(1, "/m"), (2, "/m")], "library_id int, root string")
    files = spark.createDataFrame([(1, 10, "/m/a.mp3", "audio", 4, 8, 1, 7), (1, 11, "/m/gone.mp3", "audio", 4, 8, 1, None), (1, 12, "/m/far/x.mp3", "audio", 4, 8, 1, None)], "library_id int, file_id long, path string, kind string, size_bytes long, modified_s long, scanned_s long, missing_s long")
    hashes = spark.createDataFrame([(10, "sampledSha256", "old")], "file_id long, kind string, value string")
    pending = spark.createDataFrame([], "library_id int, path string, size_bytes long, modified_ms long, stage string")
    seen = []

    def broken(result):
        raise RuntimeError("observer")

    hooks = full_scan.Hooks(lambda read: read.select("library_id", "path", F.md5("path").alias("value")), lambda media, others: others.select("path"), lambda read: read.select("file_id", F.lit("{}").alias("metadata")), [lambda r: seen.append(r.files.count()), broken])
    unsafe = spark.createDataFrame([("/m/far",)], "path string")
    got = full_scan.told(full_scan.scan(listing, roots, files, hashes, files.select("file_id").limit(0), pending, F.lit(50).cast("long"), hooks, unsafe=unsafe), hooks)
    rows = {(r.library_id, r.path): r for r in got.files.collect()}
    assert set(rows) == {(1, "/m/a.mp3"), (2, "/m/a.mp3"), (1, "/m/gone.mp3"), (1, "/m/far/x.mp3")}
    assert (rows[1, "/m/a.mp3"].file_id, rows[1, "/m/a.mp3"].missing_s, rows[1, "/m/a.mp3"].size_bytes) == (10, None, 5)
    assert rows[1, "/m/gone.mp3"].missing_s == 50 and rows[1, "/m/far/x.mp3"].missing_s is None
    assert seen == [4] and got.failures == ["RuntimeError: observer"]
    assert {r.value for r in got.hashes.collect()} == {__import__("hashlib").md5(b"/m/a.mp3").hexdigest()}
    assert got.metadata.count() == 2 and {r.path for r in got.sidecars.collect()} == {"/m/b.srt"}
    tallied = {r.library_id: (r.seen, r.added, r.updated, r.missing, r.sidecars) for r in got.tally.collect()}
    assert tallied == {1: (1, 0, 1, 1, 1), 2: (1, 1, 0, 0, 1)}


def test_debt_of_busy_libraries(spark):
    from medialake.streaming import jobs

    dirs, debt, busy = (spark.createDataFrame(rows, s) for rows, s in (([(1, "/a"), (2, "/b")], "library_id long, dir string"), ([(1, "/c"), (2, "/b")], "library_id long, dir string"), ([(1,)], "library_id long")))
    now, later = jobs.with_debt(dirs, debt, busy)
    assert [tuple(r) for r in now.collect()] == [(2, "/b")] and sorted(tuple(r) for r in later.collect()) == [(1, "/a"), (1, "/c")]


def test_whole_shelves_are_in_order(spark, duck):
    """The sort queries return whole shelves; their order is that of the SQL."""
    from medialake import plans

    for name in ("so01_songs_by_year_desc", "so04_artists_by_songs", "so07_movies_by_resolution", "so02_songs_title_desc"):
        got = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        rows = [tuple(r) for r in got.collect()]
        want = duck.sql(plans.ORACLE_SQL[name])
        assert rows == [tuple(dict(zip(want.columns, r))[c] for c in got.columns) for r in want.fetchall()], name


def test_revisions_are_dense_and_repeatable(spark):
    from medialake.operators import changes

    events = spark.range(500).select(F.col("id").cast("string").alias("path"))
    a, b = ({r.path: r.revision for r in changes.with_revision(rows, "e", 3).collect()} for rows in (events, events.repartition(7)))
    assert a == b and sorted(a.values()) == [3 * 2**40 + i for i in range(500)]


def test_marks_are_no_letters(spark):
    from medialake.operators import search

    row = spark.createDataFrame([("Dvořák e\u0301te Łódź Ñandú",)], "t string").select(search.tokens(F.col("t")).alias("x")).first()
    assert row.x == ["dvorak", "ete", "łodz", "nandu"]


def test_extractors_as_table_functions(spark):
    """The same rows from SQL as from `tiers`; a file that fails is a row with an error and costs no other its row."""

    def picky(batches):
        for df in batches:
            if (df.path == "/b.mp3").any():
                raise ValueError("broken file")
            yield df[["file_id"]].assign(title="t" + df.path, n=df.file_id * 2)

    known = Extractors()
    known.register("picky", ("audio",), ("mp3",), picky, 1)
    known.register("all", ("audio", "video"), (), lambda batches: (df[["file_id"]].assign(title=None, n=7) for df in batches), 2)
    files = spark.createDataFrame([(i, f"/{x}", k, "more") for i, (x, k) in enumerate([("a.mp3", "audio"), ("b.mp3", "audio"), ("c.MP3", "audio"), ("d.flac", "audio"), ("e.mkv", "video"), ("f.pdf", "document")])], "file_id long, path string, kind string, size string")
    files.createOrReplaceTempView("files_to_read")
    names = known.register_sql(spark, "title string, n long")
    rows = [r for name in names for r in spark.sql(f"SELECT * FROM {name}(TABLE(files_to_read) PARTITION BY kind)").collect()]
    assert sorted((r.file_id, r.tier, r.title, r.n) for r in rows if r.error is None) == sorted((r.file_id, r.tier, r.title, r.n) for r in known.tiers(files, "title string, n long").collect())
    assert [(r.file_id, r.tier, r.error) for r in rows if r.error] == [(1, 1, "ValueError: broken file")]
    lateral = spark.sql("SELECT f.size, x.title FROM files_to_read f, LATERAL extract_picky(f.file_id, f.path, f.kind) x WHERE x.error IS NULL").collect()
    assert sorted(r.title for r in lateral) == ["t/a.mp3", "t/c.MP3"] and {r.size for r in lateral} == {"more"}


def test_artist_chain_of_tags(spark):
    from medialake.operators import normalise

    rows = [(1, "id3v2", 0, "TPE1", "Lead"), (1, "id3v2", 1, "TPE2", "Band"), (2, "id3v2", 0, "TPE2", "Band"), (3, "id3v2", 0, "TOPE", "First"), (4, "vorbis", 0, "ALBUMARTIST", "Band"), (5, "id3v2", 0, "TIT2", "x")]
    got = normalise.normalise_tags(spark.createDataFrame(rows, "file_id int, dialect string, seq int, key string, value string")).collect()
    assert {r.file_id: r.artist for r in got} == {1: "Lead", 2: "Band", 3: "First", 4: None, 5: None}
    assert {r.file_id: r.extra for r in got}[3] == {"TOPE": '"First"'}
