"""Named queries over the test tables; ``plans.oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crops, hashing, parsing, paths
from ..operators import cache, curation, groups, search
from ..sources.adapters import document_items, embedding_items, file_log, page_paths, table
from . import library, media

#: Bits of the test hashes, and the tolerances that queries use.
SCALE, TOLERANCE, TIGHT, WIDE = 64, 0.35, 0.3, 0.4


def _found(spark: SparkSession, sf_dir: str, tolerance: float = TOLERANCE, constant: bool = False) -> DataFrame:
    return search.search(embedding_items(spark, sf_dir, constant), tolerance, scale=SCALE)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = embedding_items(spark, sf_dir).select("id", "w0", "label")
    return groups.members(_found(spark, sf_dir)).join(words, "id")


def hamming_pairs(spark, sf_dir):
    """Pairs within the tolerance in the self-search band."""
    pairs = search.similar_pairs(embedding_items(spark, sf_dir), TOLERANCE, scale=SCALE)
    return pairs.select("u_path", "v_path", "distance", F.round(hashing.normalised(F.col("distance"), SCALE), 6).alias("normalised"))


def hamming_histogram(spark, sf_dir):
    pairs = search.similar_pairs(embedding_items(spark, sf_dir), WIDE, scale=SCALE)
    return pairs.groupBy("distance").agg(F.count("*").alias("pairs"))


def _claims(found):
    return found.select("leader_path", "member_path", "distance")


def search_self(spark, sf_dir):
    return _claims(_found(spark, sf_dir))


def search_self_tight(spark, sf_dir):
    return _claims(_found(spark, sf_dir, TIGHT))


def search_self_constant_duration(spark, sf_dir):
    return _claims(_found(spark, sf_dir, TIGHT, True))


def _referred(spark, sf_dir, exclusive):
    items = embedding_items(spark, sf_dir)
    found = search.search_with_references(items.where("label = 0"), items.where("label <> 0"), WIDE, scale=SCALE, exclusive=exclusive)
    return found.select("reference_path", "candidate_path", "distance")


def search_refs(spark, sf_dir):
    return _referred(spark, sf_dir, False)


def search_refs_consume(spark, sf_dir):
    return _referred(spark, sf_dir, True)


def duration_band_self(spark, sf_dir):
    """For every duration, how many other items its band holds."""
    items = document_items(spark, sf_dir).groupBy("duration").agg(F.count("*").alias("n")).select(F.col("duration").alias("id"), F.col("duration").cast("string").alias("path"), "duration", "n")
    found = search.band_join(search.prefixed(items, "p_", ["n"]), search.prefixed(items, "i_", ["n"]), F.col("p_duration"), hashing.self_band_end(F.col("p_duration")), F.lit(True))
    return found.groupBy(F.col("p_duration").alias("duration")).agg(F.sum("i_n").alias("in_band"))


def duration_band_ref(spark, sf_dir):
    items = document_items(spark, sf_dir).groupBy("duration").agg(F.count("*").alias("n")).select(F.col("duration").alias("id"), F.col("duration").cast("string").alias("path"), "duration", "n")
    low, high = hashing.reference_band(F.col("p_duration"))
    found = search.band_join(search.prefixed(items, "p_", ["n"]), search.prefixed(items, "i_", ["n"]), low, high, F.lit(True))
    return found.groupBy(F.col("p_duration").alias("duration")).agg(F.sum("i_n").alias("in_band"))


def group_pairs(spark, sf_dir):
    return groups.pairs(_members(spark, sf_dir)).select("group_id", "a_path", "b_path")


def group_sizes(spark, sf_dir):
    return groups.sizes(_members(spark, sf_dir))


def group_max_distance(spark, sf_dir):
    return groups.max_distance(_members(spark, sf_dir))


def group_members(spark, sf_dir):
    """Members of each group in output order, its leader last."""
    order = Window.partitionBy("group_id").orderBy("last", "duration", "path")
    return _members(spark, sf_dir).select("group_id", (F.row_number().over(order) - 1).alias("place"), "path")


def _sorted(spark, sf_dir, key: Callable, reverse: bool):
    members = _members(spark, sf_dir)
    lead = members.where("last = 1").select("group_id", F.col("duration").alias("lead_duration"), F.col("path").alias("lead_path"))
    first = members.groupBy("group_id").agg(F.min(F.struct("last", "duration", "path")).alias("first"))
    table_ = groups.sizes(members).join(groups.max_distance(members), "group_id").join(lead, "group_id").join(first, "group_id")
    value = key(table_)
    # groups come in reverse order of their leaders; that order settles ties
    order = [value.asc() if not reverse else value.desc(), F.desc("lead_duration"), F.desc("lead_path")]
    return groups.ranked(table_.select("group_id", "size", "max_distance", "lead_duration", "lead_path", "first"), order).select("group_id", "place")


def sort_num_matches(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: -t["size"], False)


def sort_num_matches_rev(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: -t["size"], True)


def sort_distance(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: t["max_distance"], False)


def sort_distance_rev(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: t["max_distance"], True)


def sort_duration(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: -t["first"]["duration"], False)


def sort_duration_rev(spark, sf_dir):
    return _sorted(spark, sf_dir, lambda t: -t["first"]["duration"], True)


def unique_paths(spark, sf_dir):
    items = embedding_items(spark, sf_dir)
    return groups.unique_items(items, _members(spark, sf_dir)).select("path")


def path_filter(spark, sf_dir):
    docs = document_items(spark, sf_dir)
    return docs.where(paths.includes(F.col("path"), ["/src1", "/src2", "/src3/en"], ["/src2/fr"])).select("path")


def ext_filter(spark, sf_dir):
    """Pages by extension, and whether a list of extensions bars them."""
    rows = page_paths(spark, sf_dir)
    kept = paths.includes(F.col("path"), ["/"], (), ["html", "PNG", "DS_Store"])
    return rows.select("id", paths.extension(F.col("path")).alias("extension"), kept.alias("kept"))


def role_split(spark, sf_dir):
    docs = document_items(spark, sf_dir)
    every, candidate, reference = paths.roles(F.col("path"), ["/src1", "/src2"], ["/src3"], ["/src2/de"])
    return docs.where(every).select("path", F.when(reference, "reference").when(candidate, "candidate").alias("role"))


def path_parts(spark, sf_dir):
    docs = document_items(spark, sf_dir)
    p = F.col("path")
    return docs.select(
        "path", paths.basename(p).alias("base"), paths.dirname(p).alias("folder"), paths.with_extension(p, F.lit("/x/y.mp4")).alias("as_mp4"),
        paths.trash_path(p, "/trash/").alias("trashed"), paths.untrash_path(paths.trash_path(p, "/trash/"), "/trash/").alias("back"),
    )


def content_dups(spark, sf_dir):
    """Documents of equal content, by the first of them."""
    docs = document_items(spark, sf_dir)
    first = docs.groupBy("content_hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(first, "content_hash").select("path", "first_path", "copies")


def _copies(spark, sf_dir):
    """Edges between documents of equal content, each to the one of smallest id."""
    docs = document_items(spark, sf_dir)
    first = docs.groupBy("content_hash").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1")
    return docs, docs.join(first, "content_hash").where("id <> u").select("u", F.col("id").alias("v"))


def _confirmed(spark, sf_dir):
    docs, edges = _copies(spark, sf_dir)
    named = curation.confirmed_components(edges)
    return named.join(docs.select("id", "path", "content_hash"), "id")


def confirmed_components(spark, sf_dir):
    return _confirmed(spark, sf_dir).select("component_id", "path")


def moved_files(spark, sf_dir):
    """Copies that the confirmed groups lack, found again by content: the table
    of groups here lacks the document that each is named by."""
    docs, edges = _copies(spark, sf_dir)
    named = curation.confirmed_components(edges).join(docs.select("id", "path", "content_hash"), "id")
    return curation.moved_files(named.where("component_id <> id"), docs.select("path", "content_hash")).select("path", "component_id", "first_member")


def _rejected(spark, sf_dir):
    """Made-up verdicts, as the tables hold none: of the pairs of labelled copies,
    those whose ids add up to a multiple of three."""
    docs, _ = _copies(spark, sf_dir)
    rated = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id")
    a, b = (rated.select("content_hash", F.col("path").alias(p), F.col("toxic").alias(f"t_{p}"), F.col("id").alias(f"i_{p}")) for p in ("lo", "hi"))
    return a.join(b, "content_hash").where("lo < hi and (i_lo + i_hi) % 3 = 0").select("lo", "hi")


def falsepos_pairs(spark, sf_dir):
    return _rejected(spark, sf_dir)


def falsepos_closure(spark, sf_dir):
    """All pairs of the labelled documents of one source and language."""
    docs = document_items(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")
    return curation.rejected_pairs(docs.select(paths.dirname(F.col("path")).alias("set_id"), "path"))


def missed_matches(spark, sf_dir):
    """Confirmed pairs across folders: the confirmed pairs within a folder stand
    for what a search found, and no search is run."""
    confirmed = _confirmed(spark, sf_dir)
    found = curation.component_pairs(confirmed).where(paths.dirname(F.col("lo")) == paths.dirname(F.col("hi")))
    return curation.missed_matches(confirmed, found)


def validation_failures(spark, sf_dir):
    return curation.validation_failures(_confirmed(spark, sf_dir), _rejected(spark, sf_dir))


def unmatch_groups(spark, sf_dir):
    return curation.unmatch(_confirmed(spark, sf_dir), _rejected(spark, sf_dir)).select("component_id", "path")


def drop_deleted(spark, sf_dir):
    """Confirmed groups after the files of one source are gone."""
    confirmed = _confirmed(spark, sf_dir)
    gone = confirmed.where(paths.under(F.col("path"), ["/src1", "/src2"]))
    return curation.drop_items(confirmed, gone).select("component_id", "path")


def _confirmed_groups(spark, sf_dir):
    """Groups whose members come in the reverse order of their ids."""
    place = F.row_number().over(Window.partitionBy("component_id").orderBy(F.desc("id")))
    return _confirmed(spark, sf_dir).select(F.col("component_id").alias("group_id"), "path", F.lit(False).alias("is_reference"), place.alias("place"))


def filter_groups(spark, sf_dir):
    kept = paths.includes(F.col("path"), ["/"], ["/src1", "/src3"])
    return groups.filter_members(_confirmed_groups(spark, sf_dir), kept).select("group_id", "path")


def extract_reference(spark, sf_dir):
    return groups.extract_references(_confirmed_groups(spark, sf_dir), paths.under(F.col("path"), ["/src1", "/src2", "/src3"]))


def remove_known(spark, sf_dir):
    """Groups by length, members in the reverse order of their ids, without what
    is confirmed already."""
    docs = document_items(spark, sf_dir)
    group = (F.col("duration") % 50).cast("bigint")
    rough = docs.select(group.alias("group_id"), "path", (-F.col("id")).alias("place"))
    return groups.remove_known(rough, _confirmed(spark, sf_dir).select("component_id", "path"))


def remove_falsepos(spark, sf_dir):
    return groups.remove_false_positives(_confirmed_groups(spark, sf_dir), _rejected(spark, sf_dir))


def _cache_and_listing(spark, sf_dir):
    """A made-up older state: the events of even ids as a cache, where paths of
    a length divisible by seven are errors, and what is listed: the last times of
    the whole log, without the paths of a length divisible by five."""
    log = file_log(spark, sf_dir)
    known = log.where("event_id % 2 = 0").groupBy("path").agg(F.max("mtime").alias("mtime"))
    known = known.withColumn("err_kind", F.when(F.length("path") % 7 == 0, "NotVideo"))
    listing = log.groupBy("path").agg(F.max("mtime").alias("mtime")).where("length(path) % 5 <> 0")
    return known, listing


def change_detect(spark, sf_dir):
    return cache.changes(*reversed(_cache_and_listing(spark, sf_dir)))


def cache_upsert(spark, sf_dir):
    known, listing = _cache_and_listing(spark, sf_dir)
    todo = cache.changes(listing, known)
    fresh = listing.join(todo.where("action = 'update'"), "path", "left_semi").withColumn("err_kind", F.lit(None).cast("string"))
    return cache.upsert(known, fresh, todo.where("action = 'remove'"))


def reload_errors(spark, sf_dir):
    known, listing = _cache_and_listing(spark, sf_dir)
    return cache.changes(listing, cache.reload(known, "errors"))


def prune_deleted(spark, sf_dir):
    known, listing = _cache_and_listing(spark, sf_dir)
    return curation.prune(known, listing).select("path", "mtime")


def sampling_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seconds = (F.col("n_chars") / 100.0).alias("seconds")
    return docs.select("doc_id", seconds, parsing.sampling_plan(F.col("n_chars") / 100.0).alias("p")).select("doc_id", "seconds", "p.fps_num", "p.fps_den", F.round("p.seek", 6).alias("seek"))


def _crops(spark, sf_dir):
    k = F.col("o_orderkey")
    one = crops.crop(F.lit(100), F.lit(80), k % 30, k % 23, k % 17, k % 19)
    two = crops.crop(F.lit(100), F.lit(80), k % 7, k % 41, k % 29, k % 11)
    return table(spark, sf_dir, "orders").select("o_orderkey", one.alias("a"), two.alias("b"))


def crop_algebra(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    u = crops.union(a, b)
    return _crops(spark, sf_dir).select(
        "o_orderkey", u["left"].alias("u_left"), u["right"].alias("u_right"), u["top"].alias("u_top"), u["bottom"].alias("u_bottom"),
        crops.area(a).alias("area"), F.round(crops.aspect_ratio(a), 6).alias("aspect"), crops.biggest(a, b)["left"].alias("biggest_left"),
        crops.is_uncropped(a).alias("uncropped"), crops.erode(a)["left"].alias("eroded_left"), crops.view(b)["width"].alias("view_width"),
    )


def quality_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    value = F.col("l_quantity")
    return rows.select("l_orderkey", "l_linenumber", F.round(groups.quality_rank(value, ["l_orderkey"], value != 0), 6).alias("quality"))


def frame_pair_diff(spark, sf_dir):
    """Differences of neighbouring values of a user, those below eight as none."""
    rows = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    diff = F.abs(F.floor(F.col("value")) - F.floor(F.lag("value").over(order)))
    return rows.select("user_id", F.when(diff >= 8, diff).otherwise(0).alias("d")).groupBy("user_id").agg(F.sum("d").cast("bigint").alias("change"))


def resolution_parse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = (
        F.when(k % 7 == 0, F.concat((k % 9).cast("string"), F.lit(" as "), (k % 5).cast("string"), F.lit(" at "), (k % 4).cast("string")))
        .when(k % 7 == 1, F.concat((k % 9).cast("string"), F.lit(" at "), (k % 5).cast("string"), F.lit(" as "), (k % 4).cast("string")))
        .when(k % 7 == 2, F.concat((k % 9).cast("string"), F.lit(" at "), (k % 5).cast("string")))
        .when(k % 7 == 3, F.concat((k % 9).cast("string"), F.lit(" as "), (k % 5).cast("string")))
        .when(k % 7 == 4, (k % 9).cast("string"))
        .when(k % 7 == 5, F.concat(F.lit("u"), (k % 9).cast("string")))
        .otherwise(F.lit("keep this"))
    )
    text = F.when(k % 11 == 3, F.replace(text, F.lit(" "), F.lit(""))).when(k % 11 == 5, F.concat(text, F.lit("98765432109876543210"))).otherwise(text)
    rows = part.select("p_partkey", text.alias("text"), parsing.instruction(text).alias("i"))
    errors = F.when(F.col("i").isNotNull(), parsing.instruction_errors(F.col("i"), F.lit(6)))
    return rows.select("p_partkey", "text", "i.untrash", "i.basename_idx", "i.dirname_idx", "i.contents_idx", errors.alias("errors"))


def rotation_parse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.element_at(F.array(*map(F.lit, ("0", "90", "-90", "180", "-180", "270", "-270", "45", "x", ""))), (F.col("p_partkey") % 10 + 1).cast("int"))
    return part.select("p_partkey", parsing.rotation(text).alias("rotation"))


def probe_json(spark, sf_dir):
    """Probe output made from events, and what is read from it."""
    rows = table(spark, sf_dir, "events")
    text = F.format_string(
        '{"format":{"duration":"%d.5","size":"%d"},"streams":[{"codec_type":"audio"},{"codec_type":"video","width":%d,"height":1080,"side_data_list":[{"rotation":%d}]}]}',
        F.col("event_id") % 100, F.col("event_id") * 10, F.col("event_id") % 1920 + 1, (F.col("event_id") % 4) * 90,
    )
    return rows.select("event_id", parsing.probe_info(text).alias("p")).select("event_id", "p.*")


def display_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return rows.select("o_orderkey", parsing.clock(k * 7).alias("clock"), parsing.dimensions(k, k + 1).alias("dimensions"))


ALL = (
    hamming_pairs, hamming_histogram, search_self, search_self_tight, search_self_constant_duration, search_refs, search_refs_consume,
    duration_band_self, duration_band_ref, group_pairs, group_sizes, group_max_distance, group_members, sort_num_matches, sort_num_matches_rev,
    sort_distance, sort_distance_rev, sort_duration, sort_duration_rev, unique_paths, path_filter, ext_filter, role_split, path_parts, content_dups,
    confirmed_components, moved_files, falsepos_pairs, falsepos_closure, missed_matches, validation_failures, unmatch_groups, drop_deleted,
    filter_groups, extract_reference, remove_known, remove_falsepos, change_detect, cache_upsert, reload_errors, prune_deleted, sampling_plan,
    crop_algebra, quality_rank, frame_pair_diff, resolution_parse, rotation_parse, probe_json, display_formats,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL} | media.queries() | library.queries()
