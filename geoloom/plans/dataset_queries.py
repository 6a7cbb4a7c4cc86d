"""Queries of the file, label, detection-merge and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import text
from geoloom.operators import detect, files, labels
from geoloom.plans import views
from geoloom.plans.registry import query

_I = f"with {views.IMAGES}"


@query(f"""{_I}, a as (select distinct stem, 1 as l from imgs), b as (select distinct stem, 1 as r from lbls), j as (select coalesce(a.stem, b.stem) as stem, l, r from a full join b on a.stem = b.stem)
select count(l) as left_count, count(r) as right_count, count(*) filter (l is not null and r is not null) as matched_count, count(*) filter (r is null) as missing_on_right, count(*) filter (l is null) as missing_on_left from j""")
def pairing_report(spark, d):
    return files.pairing_report(views.images(spark, d), views.label_files(spark, d))


@query(f"{_I} select 'delete_image' as action, path as src from imgs where stem not in (select stem from lbls) union all select 'delete_label', path from lbls where stem not in (select stem from imgs)")
def orphans_delete_plan(spark, d):
    return files.orphan_plan(views.images(spark, d), views.label_files(spark, d))


@query(f"""{_I}, r as (select stem, path, row_number() over (partition by stem order by list_position(['png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff', 'webp'], ext)) as k from imgs)
select l.stem, r.path as img_path, l.path as lbl_path, l.density from lbls l join r on l.stem = r.stem and k = 1""")
def label_samples(spark, d):
    return files.label_samples(views.images(spark, d), views.label_files(spark, d))


@query(f"{_I}, r as (select stem, path, row_number() over (partition by stem order by list_position(['png', 'jpg', 'tif', 'webp'], ext) desc) as k from imgs) select stem, path from r where k = 1")
def last_extension(spark, d):
    return files.last_extension(views.images(spark, d), ["png", "jpg", "tif", "webp"])


@query(f"{_I} select stem from imgs intersect select stem from lbls")
def stems_in_both(spark, d):
    return views.images(spark, d).select("stem").intersect(views.label_files(spark, d).select("stem"))


@query(f"{_I} select stem, path from imgs where stem in (select cast(doc_id as varchar) from documents)")
def required_match(spark, d):
    stems = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    return files.require_match(views.images(spark, d).select("stem", "path"), stems)


_PARTS = ", ".join(f"'{e}'" for e in files.BUNDLE)


@query(f"""with parts as (select 's' || (ps % 90) as stem, case when (ps * 7 + length(ext)) % 9 = 0 then 'bak' else ext end as ext from (select s_suppkey as ps, unnest([{_PARTS}, 'qix']) as ext from supplier)),
rasters as (select distinct 's' || (s_suppkey % 80 + 20) as stem from supplier), have as (select stem, list(distinct ext) as exts from parts where ext not in ('qix', 'bak') group by stem),
j as (select coalesce(r.stem, h.stem) as stem, r.stem as rs, exts, list_sort(list_filter([{_PARTS}], lambda e: not list_contains(exts, e))) as lacks from rasters r full join have h on r.stem = h.stem),
k as (select *, case when exts is null then 'no_bundle' when rs is null then 'no_raster' when len(lacks) > 0 then 'incomplete' else 'complete' end as status from j)
select stem, status, case when status = 'incomplete' then array_to_string(lacks, ',') else '' end as missing from k""")
def bundle_check(spark, d):
    s = views.table(spark, d, "supplier")
    parts = s.select(F.col("s_suppkey").alias("ps"), F.explode(F.array(*map(F.lit, [*files.BUNDLE, "qix"]))).alias("ext"))
    parts = parts.select(F.concat(F.lit("s"), (F.col("ps") % 90).cast("string")).alias("stem"), F.when((F.col("ps") * 7 + F.length("ext")) % 9 == 0, "bak").otherwise(F.col("ext")).alias("ext"))
    rasters = s.select(F.concat(F.lit("s"), (F.col("s_suppkey") % 80 + 20).cast("string")).alias("stem"))
    return files.bundle_check(rasters, parts)


@query(r"""with l as (select p_partkey, 'area_' || p_partkey || case p_partkey % 4 when 0 then '_mask_Cleaned' when 1 then '_BUFFER' when 2 then '_mask_x' else '' end as stem from part)
select p_partkey, regexp_replace(stem, '(?i)(_buffer|_cleaned|_mask)+$', '') as name from l""")
def suffix_pairing(spark, d):
    p = views.table(spark, d, "part")
    k = F.col("p_partkey") % 4
    stem = F.concat(F.lit("area_"), F.col("p_partkey").cast("string"), F.when(k == 0, "_mask_Cleaned").when(k == 1, "_BUFFER").when(k == 2, "_mask_x").otherwise(""))
    return p.select("p_partkey", files.strip_suffixes(stem, ["_buffer", "_cleaned", "_mask"]).alias("name"))


@query("""with f as (select 'd' || (c_custkey % 37) || '/' || c_custkey as path, 'tile_' || (c_custkey % 400) || '.tif' as name from customer),
k as (select *, row_number() over (partition by name order by path) - 1 as k from f)
select 'copy' as action, path as src, case when k = 0 then name else replace(name, '.tif', '') || '_' || k || '.tif' end as dst from k""")
def flatten_names(spark, d):
    c = views.table(spark, d, "customer")
    f = c.select(F.concat_ws("/", F.concat(F.lit("d"), (F.col("c_custkey") % 37).cast("string")), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("tile_"), (F.col("c_custkey") % 400).cast("string"), F.lit(".tif")).alias("name"))
    return files.flatten_plan(f)


@query("""with f as (select distinct case p_partkey % 3 when 0 then 'a_' || (p_partkey // 3) || '_old' when 1 then 'a_' || (p_partkey // 6) else 'b_old_' || p_partkey end as stem, 'tif' as ext from part),
w as (select stem, ext, replace(stem, '_old', '') as n from f where replace(stem, '_old', '') <> stem),
g as (select n, ext, min(stem) as stem from w where not exists (select 1 from f where f.stem = w.n and f.ext = w.ext) group by n, ext)
select 'rename' as action, stem || '.' || ext as src, n || '.' || ext as dst from g""")
def rename_plan(spark, d):
    k, p = F.col("p_partkey") % 3, F.col("p_partkey")
    stem = F.when(k == 0, F.concat(F.lit("a_"), F.floor(p / 3).cast("string"), F.lit("_old"))).when(k == 1, F.concat(F.lit("a_"), F.floor(p / 6).cast("string"))).otherwise(F.concat(F.lit("b_old_"), p.cast("string")))
    return files.rename_plan(views.table(spark, d, "part").select(stem.alias("stem"), F.lit("tif").alias("ext")).distinct(), "_old")


@query(f"{_I} select 'delete' as action, path as src from imgs where contains(stem || '.' || ext, '7.p')")
def delete_plan(spark, d):
    return files.delete_plan(views.images(spark, d).withColumn("name", F.concat_ws(".", "stem", "ext")), "7.p")


@query(f"{_I}, o as (select distinct stem from lbls) select i.path, case when o.stem is null then 'processed' else 'skipped_existing' end as status from imgs i left join o on i.stem = o.stem")
def incremental_todo(spark, d):
    return files.todo(views.images(spark, d).select("stem", "path"), views.label_files(spark, d)).select("path", "status")


_L = f"with {views.LABEL_LINES}, t as (select *, list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '') as w from lines), n as (select *, list_transform(w, lambda x: try_cast(x as double)) as v from t where len(w) > 0)"


@query(f"""{_L} select stem, line_no, case when len(w) < 5 then 'too_few' when len(list_filter(v, lambda x: x is null)) > 0 then 'not_numeric' else 'out_of_range' end as issue from n
where len(w) < 5 or len(list_filter(v, lambda x: x is null)) > 0 or len(list_filter(v[2:], lambda x: x < 0 or x > 1)) > 0""")
def validate_a(spark, d):
    return labels.issues_boxes(views.label_lines(spark, d))


_B = f"""{_L}, i as (select stem, line_no, unnest(case when len(w) < 7 or len(w) % 2 = 0 then ['bad_shape'] when len(list_filter(v, lambda x: x is null)) > 0 then ['not_numeric']
 else list_filter([case when v[1] <> floor(v[1]) then 'class_not_integer' end, case when len(list_filter(v[2:], lambda x: not (x between 0 and 1))) > 0 then 'out_of_range' end], lambda x: x is not null) end) as issue from n)"""


@query(f"{_B} select * from i")
def validate_b(spark, d):
    return labels.issues_polygons(views.label_lines(spark, d))


@query(f"{_B} select * from i order by stem, line_no, issue limit 20")
def issues_top20(spark, d):
    """The report's first 20 issues: the limit is the feature."""
    return labels.first_issues(labels.issues_polygons(views.label_lines(spark, d)))


@query(f"{_L} select stem, line_no, cast(trunc(v[1]) as integer) as class_id, round(list_sum(v[2:]), 6) as total from n where len(w) >= 5 and len(list_filter(v, lambda x: x is null)) = 0")
def parse_labels(spark, d):
    out = labels.parse_labels(views.label_lines(spark, d))
    return out.select("stem", "line_no", "class_id", F.round(F.aggregate("coords", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query(f"""{_I}, s as (select *, row_number() over (order by density, stem) as r, count(*) over () as n from lbls) select stem, density, cast((3 * r - 1) // n as integer) as bin from s""")
def density_bins(spark, d):
    return labels.density_bins(views.label_files(spark, d).select("stem", "density"), 3)


@query(f"""{_I}, s as (select *, row_number() over (order by density, stem) as r, count(*) over () as n from lbls), b as (select stem, density, (3 * r - 1) // n as bin, n from s),
c as (select bin, count(*) as size, any_value(n) as n from b group by bin), q as (select bin, size, n, round_even(round_even(n * 0.2, 0) * size / n, 0) as q0 from c),
f as (select bin, q0 + case when row_number() over (order by bin) <= abs((select round_even(any_value(n) * 0.2, 0) - sum(q0) from q)) then sign((select round_even(any_value(n) * 0.2, 0) - sum(q0) from q)) else 0 end as quota from q),
k as (select b.*, row_number() over (partition by bin order by md5('42:' || stem), stem) as k from b)
select stem, cast(k.bin as integer) as bin, case when k.k <= f.quota then 'val' else 'train' end as split from k join f on k.bin = f.bin""")
def stratified_split(spark, d):
    return labels.stratified_split(views.label_files(spark, d).select("stem", "density"), 3, 0.2).select("stem", "bin", "split")


@query(f"""{_I}, s as (select stem, density, case when row_number() over (order by md5('42:' || stem), stem) <= floor(count(*) over () * 0.2) then 'val' else 'train' end as split from lbls)
select split, count(*) as n, round(avg(density), 6) as mean, min(density) as lo, max(density) as hi from s group by split""")
def split_summary(spark, d):
    out = labels.density_summary(labels.random_split(views.label_files(spark, d).select("stem", "density"), 0.2, floor=True))
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""{_I}, r as (select stem, path, row_number() over (partition by stem order by list_position(['png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff', 'webp'], ext)) as k from imgs),
s as (select l.stem, r.path as i, l.path as l, case when row_number() over (order by md5('42:' || l.stem), l.stem) <= round_even(count(*) over () * 0.25, 0) then 'val' else 'train' end as split from lbls l join r on l.stem = r.stem and k = 1)
select 'copy' as action, i as src, 'images/' || split || '/' || string_split(i, '/')[2] as dst from s union all select 'copy', l, 'labels/' || split || '/' || string_split(l, '/')[2] from s""")
def dataset_plan(spark, d):
    return labels.dataset_plan(labels.random_split(label_samples(spark, d), 0.25))


_C = f"""with {views.POLYGONS}, xy as (select *, list_transform(range(1, len(coords) + 1), lambda i: coords[i] * case when i % 2 = 1 then 640.0 else 480.0 end) as xy from poly),
b as (select *, case when len(coords) = 4 then [(coords[1] - coords[3] / 2) * 640, (coords[2] - coords[4] / 2) * 480, coords[3] * 640, coords[4] * 480]
 else [list_min(xs), list_min(ys), list_max(xs) - list_min(xs), list_max(ys) - list_min(ys)] end as bbox from (select *, list_transform(range(1, len(xy), 2), lambda i: xy[i]) as xs, list_transform(range(2, len(xy) + 1, 2), lambda i: xy[i]) as ys from xy))"""


@query(f"{_C} select stem, line_no, class_id + 1 as category_id, round(bbox[1], 6) as bx, round(bbox[2], 6) as by, round(bbox[3], 6) as bw, round(bbox[4], 6) as bh, round(bbox[3] * bbox[4], 6) as area, 0 as iscrowd, case when len(coords) <> 4 then len(xy) end as n_points from b")
def coco_annotations(spark, d):
    out = labels.coco_instances(views.polygons(spark, d), F.lit(640.0), F.lit(480.0))
    box = [F.round(F.col("bbox")[k], 6).alias(c) for k, c in enumerate(("bx", "by", "bw", "bh"))]
    return out.select("stem", "line_no", "category_id", *box, F.round("area", 6).alias("area"), "iscrowd", F.when(F.col("segmentation").isNotNull(), F.size(F.col("segmentation")[0]).cast("long")).alias("n_points"))


@query("with t as (select greatest(max(label), 1) as top from embeddings) select k + 1 as id, case k when 0 then 'ridge' when 1 then 'valley' else 'class_' || k end as name from (select unnest(range(0, top + 1)) as k from t)")
def coco_categories(spark, d):
    return labels.coco_categories(views.polygons(spark, d), ["ridge", "valley"])


@query(f"""{_I}, s as (select stem, case when row_number() over (order by md5('42:' || stem), stem) <= floor(count(*) over () * 0.2) then 'val' else 'train' end as split from (select distinct stem from imgs))
select stem, split, row_number() over (partition by split order by md5('42:' || stem), stem) as id from s""")
def coco_images(spark, d):
    split = labels.random_split(views.images(spark, d).select("stem").distinct(), 0.2, floor=True)
    out = labels.numbered(split.withColumn("o", labels.seeded(F.col("stem"), 42)), "split", ["o", "stem"])
    return out.select("stem", "split", "id")


@query(f"with {views.POLYGONS} select 'img_' || k as stem, coalesce(n, 0) as n_lines from (select unnest(range(0, 60)) as k) left join (select stem, count(*) as n from poly group by stem) on stem = 'img_' || k")
def yolo_lines(spark, d):
    tiles = spark.range(60).select(F.concat(F.lit("img_"), F.col("id").cast("string")).alias("stem"))
    out = labels.yolo_text(views.polygons(spark, d), tiles)
    return out.select("stem", F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


_PIX = f"""with {views.BOXES}, p as (select cast(det % 40 as integer) as y, cast(floor(x1) as integer) as x, cls, abs(conf) as conf, det as seq, cls % 3 as pri from boxes)"""


def _pixels(spark, d):
    b = views.boxes(spark, d)
    return b.select((F.col("det") % 40).cast("int").alias("y"), F.floor("x1").cast("int").alias("x"), "cls", F.abs("conf").alias("conf"), F.col("det").alias("seq"), (F.col("cls") % 3).alias("pri"))


@query(f"{_PIX}, r as (select *, row_number() over (partition by y, x order by conf desc, seq) as k from p where conf > 0) select y, x, cls, conf from r where k = 1")
def merge_strict(spark, d):
    return detect.merge_strict(_pixels(spark, d))


@query(f"{_PIX}, r as (select *, row_number() over (partition by y, x order by pri desc, conf desc, seq desc) as k from p) select y, x, cls, conf from r where k = 1")
def merge_priority(spark, d):
    return detect.merge_priority(_pixels(spark, d))


@query(f"{_PIX} select y, x, cls, max(conf) as conf from p group by y, x, cls")
def class_confidence(spark, d):
    return detect.class_confidence(_pixels(spark, d))


_DEC = "with s as (select vec_id, list_transform(embedding[1:12], lambda e: cast(e as double)) as v from embeddings), m as (select vec_id, v, list_max(v[5:8]) as conf from s)"


@query(f"""{_DEC} select vec_id as det, cast(list_position(v[5:8], conf) - 1 as integer) as cls, conf,
round(greatest(0, least(639, (v[1] - v[3] / 2) * 640)), 6) as x1, round(greatest(0, least(479, (v[2] - v[4] / 2) * 480)), 6) as y1, round(greatest(0, least(639, (v[1] + v[3] / 2) * 640)), 6) as x2, round(greatest(0, least(479, (v[2] + v[4] / 2) * 480)), 6) as y2
from m where conf > 0.1""")
def decode_dets(spark, d):
    raw = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("det"), F.transform(F.slice("embedding", 1, 12), lambda e: e.cast("double")).alias("v"))
    out = detect.decode(raw, 4, 0.1, 640, 480)
    return out.select("det", "cls", "conf", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""with s as (select vec_id, list_transform(embedding, lambda e: cast(e as double)) as v from embeddings)
select vec_id as det, round(1 / (1 + exp(-list_sum(list_transform(range(1, 33), lambda i: v[i] * v[i + 32])))), 6) as p from s""")
def mask_logits(spark, d):
    v = F.transform("embedding", lambda e: e.cast("double"))
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("det"), F.round(detect.mask_probability(F.slice(v, 1, 32), F.slice(v, 33, 32)), 6).alias("p"))


@query(f"{_PIX} select cls, y, count(*) as n from p group by cls, y having count(*) >= 2")
def small_instances(spark, d):
    return detect.small_instances(_pixels(spark, d), ["cls", "y"], 2)


@query("""select coalesce(region, '') as region, name, acct from (
 select 'a' as region, n_name as name, null::double as acct from nation union all select null, s_name, s_acctbal from supplier) order by name""")
def union_sheets_sorted(spark, d):
    a = views.table(spark, d, "nation").select(F.lit("a").alias("region"), F.col("n_name").alias("name"))
    b = views.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acct"))
    out = a.unionByName(b, allowMissingColumns=True)
    return out.select(F.coalesce("region", F.lit("")).alias("region"), "name", "acct").orderBy(F.col("name").asc_nulls_last())


@query(r"""select page_id, list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1), lambda v: v <> '') as links from pages""")
def html_attrs(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.tag_attributes(F.col("html"), "a", "href").alias("links"))


_U = "case page_id % 5 when 0 then '//cdn.example.com/a.PNG?x=1' when 1 then '/rel/b.jpeg' when 2 then url when 3 then 'plain/c.txt' else '' end"


@query(f"""with u as (select page_id, url as base, {_U} as u from pages)
select page_id, case when u = '' then '' when u like '//%' then 'https:' || u when u like '/%' then 'https://mp.weixin.qq.com' || u when regexp_matches(u, '^https?://') then u else 'https://mp.weixin.qq.com/' || ltrim(u, '/') end as full_url,
 case when regexp_extract(lower(regexp_replace(u, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|webp|bmp)$', 0) = '' then '.jpg' else regexp_extract(lower(regexp_replace(u, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|webp|bmp)$', 0) end as ext from u""")
def url_norm(spark, d):
    p = views.table(spark, d, "pages").withColumn("u", F.expr(_U))
    return p.select("page_id", text.absolute_url(F.col("u")).alias("full_url"), text.image_extension(F.col("u")).alias("ext"))


@query("""with e as (select event_id, '<script>var msgList = ''{&quot;list&quot;:[{&quot;app_msg_ext_info&quot;:{&quot;title&quot;:&quot;' || event_type || '&quot;,&quot;cover&quot;:&quot;c' || user_id || '&quot;}}]}'';</script>' as html, event_type, user_id from events)
select event_id, event_type as title, 'c' || user_id as cover from e""")
def embedded_json(spark, d):
    quot = "&quot;"
    html = F.concat(F.lit(f"<script>var msgList = '{{{quot}list{quot}:[{{{quot}app_msg_ext_info{quot}:{{{quot}title{quot}:{quot}"), F.col("event_type"), F.lit(f"{quot},{quot}cover{quot}:{quot}c"), F.col("user_id").cast("string"), F.lit(f"{quot}}}}}]}}';</script>"))
    e = views.table(spark, d, "events").select("event_id", F.explode_outer(text.articles(text.embedded_json(html, ["nothing = '(.*?)'", "msgList = '(.*?)';"]))).alias("a"))
    return e.select("event_id", "a.title", "a.cover")
