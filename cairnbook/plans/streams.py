"""Streaming queries; each runs to the end of what its table holds and returns what it wrote (ST1-ST9)."""

from pyspark.sql import functions as F

from cairnbook.operators import drift, keyed, leases
from cairnbook.operators.sinks import read_snapshot
from cairnbook.plans.logs import HISTORY_SQL
from cairnbook.plans.profiles import TABLES
from cairnbook.plans.registry import query
from cairnbook.session import hadoop_path, new_dir
from cairnbook.sources import listing
from cairnbook.streaming import changes, jobs


def _stream(t, name):
    """Stream over one table, be it a file or a folder of files: hence the path as a glob."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.root}/[{name[0]}]{name[1:]}.parquet")


def _events(t):
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(t, df, label):
    out, checkpoint = new_dir(t.spark, label), new_dir(t.spark, f"{label}-state")
    jobs.run_available(df, out, checkpoint)
    return t.spark.read.parquet(out)


@query("st1_watch_files", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, (SELECT count(*) FROM {n}) AS row_count" for n in TABLES))
def _st1(t):
    """Every file of the data folder arrives as new and is described in its micro-batch."""
    out = new_dir(t.spark, "watch")
    jobs.catalog_stream(t.spark, t.root, out, new_dir(t.spark, "watch-state"), maxFilesPerTrigger="8")
    records = t.spark.read.parquet(out)
    return records.groupBy(F.regexp_extract("relative_path", r"^([^/.]+)\.", 1).alias("dataset")).agg(
        F.sum("row_count").alias("row_count"))


_FOLDER_RUNS = """(SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even
  FROM documents GROUP BY 1)"""


def _changing_folder(t):
    """A folder of CSV files by language, and a second state of it: English written anew, German gone, a copy of French added."""
    root = new_dir(t.spark, "lake")
    docs = t.documents.select("doc_id", "lang", "source")
    write = docs.repartition("lang").write.partitionBy("lang").option("header", "true")
    write.csv(f"{root}/docs")

    def move_on():
        conf = t.spark.conf
        before = conf.get("spark.sql.sources.partitionOverwriteMode")
        conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        docs.where("lang = 'en' AND doc_id % 2 = 0").repartition("lang").write.mode("overwrite").partitionBy("lang").option(
            "header", "true").csv(f"{root}/docs")
        conf.set("spark.sql.sources.partitionOverwriteMode", before)
        fs, place = hadoop_path(t.spark, f"{root}/docs/lang=de")
        fs.delete(place, True)
        docs.where("lang = 'fr'").drop("lang").coalesce(1).write.option("header", "true").csv(f"{root}/docs/lang=copy")

    return root, move_on


@query("st1_folder_changes", sql=f"""
SELECT 0 AS run, 'created' AS change, lang, 1 AS files FROM {_FOLDER_RUNS}
UNION ALL SELECT 1, 'removed', lang, 1 FROM {_FOLDER_RUNS} WHERE lang IN ('en', 'de')
UNION ALL SELECT 1, 'created', lang, 1 FROM {_FOLDER_RUNS} WHERE lang = 'en' AND even > 0
UNION ALL SELECT 1, 'created', 'copy', 1 FROM {_FOLDER_RUNS} WHERE lang = 'fr'""")
def _st1c(t):
    """What a folder of documents gains and loses between two runs of one stream, told once each; a third run tells nothing."""
    root, move_on = _changing_folder(t)
    out, manifests, checkpoint = (new_dir(t.spark, n) for n in ("changes", "manifests", "changes-ck"))
    for step in range(3):
        if step == 1:
            move_on()
        jobs.run_batches(changes.watch_changes(t.spark, root, manifests), lambda df, n: jobs.write_batch(df, out, n), checkpoint)
    told = t.spark.read.parquet(out).where(F.col("relative_path").endswith(".csv"))
    lang = F.regexp_extract("relative_path", r"lang=([^/]*)/", 1)
    return told.groupBy(F.col("batch_id").cast("int").alias("run"), "change", lang.alias("lang")).agg(
        F.count("*").cast("int").alias("files"))


@query("st1_catalog_of_changes", sql=f"""
SELECT 0 AS run, lang, n AS rows FROM {_FOLDER_RUNS}
UNION ALL SELECT 1, lang, CASE WHEN lang = 'en' THEN even ELSE n END FROM {_FOLDER_RUNS} WHERE lang <> 'de' AND (lang <> 'en' OR even > 0)
UNION ALL SELECT 1, 'copy', n FROM {_FOLDER_RUNS} WHERE lang = 'fr'""")
def _st1w(t):
    """The catalog of that folder after each run: new files described, changed ones again, removed ones gone."""
    root, move_on = _changing_folder(t)
    base, state, runs = new_dir(t.spark, "watched"), new_dir(t.spark, "watched-state"), []
    for run in range(2):
        if run:
            move_on()
        jobs.catalog_of_changes(t.spark, root, base, state)
        records = keyed.read(t.spark, base).where("file_format = 'csv'")
        lang = F.regexp_extract("relative_path", r"lang=([^/]*)/", 1)
        runs.append(records.groupBy(lang.alias("lang")).agg(F.sum("row_count").alias("rows")).select(F.lit(run).alias("run"), "lang", "rows"))
    return runs[0].unionByName(runs[1])


_REFRESH = """(SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, count(*) AS n FROM documents GROUP BY 1)"""


@query("e2_refresh", sql=f"""
SELECT 'record' AS part, lang AS name, n AS value FROM {_REFRESH} WHERE lang <> 'de'
UNION ALL SELECT 'drift', 'Added ' || c, 1 FROM {_REFRESH}, (VALUES ('n_chars'), ('late')) v(c) WHERE lang = 'en'
UNION ALL SELECT 'drift', 'Removed source', 1 FROM {_REFRESH} WHERE lang = 'en'
UNION ALL SELECT 'total', 'datasets', count(*) FROM {_REFRESH} WHERE lang <> 'de'
UNION ALL SELECT 'total', 'columns', CAST(sum(CASE WHEN lang = 'en' THEN 4 ELSE 3 END) AS BIGINT) FROM {_REFRESH} WHERE lang <> 'de'
UNION ALL SELECT 'published', 'pub/' || lang || '.json', 1 FROM {_REFRESH} WHERE lang <> 'de'
UNION ALL SELECT 'errors', 'lake', 0""")
def _e2(t):
    """Two refreshes of a folder with one JSON file per language: English gets other fields, the last one late, German goes."""
    root, base, state = (new_dir(t.spark, n) for n in ("refreshed", "refreshed-catalog", "refreshed-state"))
    fs = hadoop_path(t.spark, root)[0]

    def write(rows, lang_of):
        """One file per language, under its own name."""
        staged = new_dir(t.spark, "staged")
        rows.withColumn("_lang", lang_of).repartition("_lang").sortWithinPartitions("doc_id").write.partitionBy("_lang").json(staged)
        for folder in fs.listStatus(hadoop_path(t.spark, staged)[1]):
            name = folder.getPath().getName()
            if name.startswith("_lang="):
                file = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
                target = hadoop_path(t.spark, f"{root}/{name[6:]}.json")[1]
                fs.mkdirs(target.getParent())
                fs.delete(target, False)
                fs.rename(file, target)

    write(t.documents.select("doc_id", "source", "lang").withColumn("source", F.coalesce("source", F.lit(""))), F.col("lang"))
    # Sums that a local file system keeps beside the files are no data.
    patterns = (*listing.DEFAULT_EXCLUDES, "*.crc")
    jobs.refresh(t.spark, root, base, state, "/pub", patterns)
    last = t.documents.where("lang = 'en'").agg(F.max("doc_id").alias("last"))
    english = t.documents.where("lang = 'en'").join(F.broadcast(last))
    write(english.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.when(F.col("doc_id") == F.col("last"), 1).alias("late"), "lang"), F.col("lang"))
    fs.delete(hadoop_path(t.spark, f"{root}/de.json")[1], False)
    done = jobs.refresh(t.spark, root, base, state, "/pub", patterns)
    one = F.lit(1).cast("long")
    records = done.records.select(F.lit("record").alias("part"), F.regexp_replace("relative_path", r"\.json$", "").alias("name"), F.col("row_count").alias("value"))
    found = done.drift.groupBy(F.concat_ws(" ", "kind", "name").alias("name")).agg(F.count("*").alias("value")).select(F.lit("drift").alias("part"), "name", "value")
    totals = done.totals.select(F.lit("total").alias("part"), F.inline(F.array(
        F.struct(F.lit("datasets").alias("name"), F.col("datasets").alias("value")), F.struct(F.lit("columns").alias("name"), F.col("columns").alias("value")))))
    public = done.published.select(F.lit("published").alias("part"), F.col("relative_path").alias("name"), one.alias("value"))
    errors = done.stats.select(F.lit("errors").alias("part"), F.lit("lake").alias("name"), F.col("errors").cast("long").alias("value"))
    return records.unionByName(found).unionByName(totals).unionByName(public).unionByName(errors)


@query("st8_one_sync", sql=f"SELECT lang, n AS rows, true AS second_left FROM {_FOLDER_RUNS}")
def _st8o(t):
    """Two jobs for one folder: the second finds the first at work and leaves; the catalog is that of one."""
    root, _ = _changing_folder(t)
    base, state, left = new_dir(t.spark, "synced"), new_dir(t.spark, "synced-state"), False
    lease = leases.acquire(t.spark, f"{state}/lease")
    try:
        jobs.catalog_of_changes(t.spark, root, base, state)
    except leases.LeaseTaken:
        left = True
    lease.release()
    jobs.catalog_of_changes(t.spark, root, base, state)
    records = keyed.read(t.spark, base).where("file_format = 'csv'")
    return records.groupBy(F.regexp_extract("relative_path", r"lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("row_count").alias("rows")).withColumn("second_left", F.lit(left))


def _all_bursts(t, bursts, label, key, seconds, names):
    """What a run emits, and what it leaves open at its end."""
    out, checkpoint = new_dir(t.spark, label), new_dir(t.spark, f"{label}-state")
    jobs.run_available(bursts, out, checkpoint)
    emitted = t.spark.read.schema(bursts.schema).parquet(out)
    return emitted.unionByName(jobs.open_bursts(t.spark, checkpoint, key, seconds, names))


def _sessions(key, gap, source="events"):
    """Runs of events of a key that are at most ``gap`` seconds apart."""
    cols = ", ".join(key)
    return f"""SELECT {cols}, CAST(min(us) AS BIGINT) AS first_us, CAST(max(us) AS BIGINT) AS last_us, count(*) AS n FROM (
 SELECT *, sum(opens) OVER (PARTITION BY {cols} ORDER BY us) AS sid FROM (
  SELECT {cols}, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {cols} ORDER BY ts)
    <= {gap} * 1000000::BIGINT THEN 0 ELSE 1 END AS opens FROM {source})) GROUP BY {cols}, sid"""


_ROOTS = ["/u1", "/u22/", "/u2", "/u3", "/u"]


@query("st2_debounce", sql=_sessions(["folder"], 600, """(SELECT ts, CASE
   WHEN starts_with(path, '/u1') THEN '/u1' WHEN starts_with(path, '/u22/') THEN '/u22/' WHEN starts_with(path, '/u2') THEN '/u2'
   WHEN starts_with(path, '/u3') THEN '/u3' ELSE '/u' END AS folder
  FROM (SELECT ts, '/u' || user_id || '/' || event_type AS path FROM events))"""))
def _st2(t):
    """Changed paths mapped to their folder; one row per folder and burst, most in one folder."""
    path = F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_type")
    changes = _events(t).withColumn("folder", jobs.root_of(path, _ROOTS))
    bursts = jobs.debounce(changes, "folder", "ts", quiet_seconds=600)
    return _all_bursts(t, bursts, "debounce", ["folder"], 600, ("first_change", "last_change", "changes")).select(
        "folder", F.unix_micros("first_change").alias("first_us"), F.unix_micros("last_change").alias("last_us"),
        F.col("changes").alias("n"))


@query("st3_duplicate_alerts", sql=_sessions(["user_id", "event_type"], 7200))
def _st3(t):
    alerts = jobs.suppress_duplicates(_events(t), ["user_id", "event_type"], "ts", seconds=7200)
    return _all_bursts(t, alerts, "alerts", ["user_id", "event_type"], 7200, ("first_seen", "last_seen", "repeats")).select(
        "user_id", "event_type", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"), F.col("repeats").alias("n"))


@query("st3_alert_states", sql="""
SELECT user_id, event_type, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (
 SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY us) AS sid FROM (
  SELECT user_id, event_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER
   (PARTITION BY user_id, event_type ORDER BY ts) <= 7200 * 1000000::BIGINT THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY user_id, event_type, sid""")
def _st3s(t):
    """Alert ids with their last known extent, from the stateful form."""
    states = jobs.alert_states(_events(t), ["user_id", "event_type"], "ts", seconds=7200)
    out = new_dir(t.spark, "alert-states")
    jobs.run_batches(states, lambda df, n: jobs.write_batch(df, out, n), new_dir(t.spark, "alert-states-ck"), "update")
    last = jobs.current_alerts(t.spark.read.parquet(out), ["user_id", "event_type"])
    return last.select("user_id", "event_type", F.unix_micros("first_seen").alias("first_us"),
                       F.unix_micros("last_seen").alias("last_us"), F.col("repeats").alias("n"))


@query("st4_drift_messages", sql="""
SELECT 'w' || p_size AS workspace_id, '/d/' || p_partkey || '.csv' AS dataset_path,
  p_partkey || '.csv (from ' || CASE WHEN p_size > 20 THEN p_brand ELSE 'another machine' END || ')' AS dataset_name, kind, name,
  CASE WHEN kind = 'Added' THEN NULL ELSE 'unknown' END AS old_type, CASE WHEN kind = 'Removed' THEN NULL ELSE 'unknown' END AS new_type
FROM (SELECT *, unnest(['Added', 'Added', 'Removed', 'TypeChanged']) AS kind,
  unnest([p_type, 'x' || p_size, p_name, p_brand]) AS name FROM part)
UNION ALL SELECT 'local', '/d/' || p_partkey || '.csv', p_partkey || '.csv', 'Added', p_type, NULL, 'VARCHAR' FROM part WHERE p_size > 45""")
def _st4(t):
    """Messages of other machines, streamed in as JSON text and put beside local changes."""
    added = F.array("p_type", F.concat(F.lit("x"), "p_size"))
    message = F.to_json(F.struct(
        F.concat(F.lit("w"), "p_size").alias("workspace_id"), F.concat(F.lit("/d/"), "p_partkey", F.lit(".csv")).alias("dataset_path"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).alias("origin_agent_name"),
        F.struct(added.alias("added"), F.array("p_name").alias("removed"), F.array("p_brand").alias("changed")).alias("drift")))
    inbox = new_dir(t.spark, "inbox")
    t.part.select(message.alias("value")).write.text(inbox)
    remote = drift.drift_messages(t.spark.readStream.text(inbox), "value").drop("origin_agent_id")
    local = _stream(t, "part").where("p_size > 45").select(
        F.lit("local").alias("workspace_id"), F.concat(F.lit("/d/"), "p_partkey", F.lit(".csv")).alias("dataset_path"),
        F.concat("p_partkey", F.lit(".csv")).alias("dataset_name"), F.lit("Added").alias("kind"),
        F.col("p_type").alias("name"), F.lit(None).cast("string").alias("old_type"), F.lit("VARCHAR").alias("new_type"))
    return _appended(t, remote.unionByName(local), "drift")


@query("st5_daily_counters", sql=f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS queries, CAST(sum(row_count) AS BIGINT) AS rows
FROM {HISTORY_SQL} GROUP BY ALL""")
def _st5(t):
    log = _events(t).select("ts", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
                            F.floor("value").cast("long").alias("row_count"))
    base = new_dir(t.spark, "counters")
    jobs.upsert_stream(jobs.daily_counters(log), base, ["day", "status"], new_dir(t.spark, "counters-ck"))
    return keyed.read(t.spark, base)


@query("st6_rescan", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, (SELECT count(*) FROM {n}) AS row_count, run FROM range(1, 3) r(run)" for n in TABLES))
def _st6(t):
    """The catalog after each of two rescans; nothing has changed, so the second must leave the same records."""
    state, runs = new_dir(t.spark, "rescan-state"), []
    for run in (1, 2):
        jobs.rescan(t.spark, t.root, state)
        records = read_snapshot(t.spark, f"{jobs.rescan_state(state, t.root)}/catalog")
        runs.append(records.groupBy(F.regexp_extract("relative_path", r"^([^/.]+)\.", 1).alias("dataset")).agg(
            F.sum("row_count").alias("row_count")).withColumn("run", F.lit(run).cast("long")))
    return runs[0].unionByName(runs[1])


@query("st6_rescan_changes", sql=f"""
SELECT 0 AS run, lang, n AS rows, (SELECT count(*) FROM {_FOLDER_RUNS}) AS files_read FROM {_FOLDER_RUNS}
UNION ALL SELECT 1, lang, CASE WHEN lang = 'en' THEN even ELSE n END, (SELECT count(*) FROM {_FOLDER_RUNS} WHERE lang = 'fr' OR lang = 'en' AND even > 0)
 FROM {_FOLDER_RUNS} WHERE lang <> 'de' AND (lang <> 'en' OR even > 0)
UNION ALL SELECT 1, 'copy', n, (SELECT count(*) FROM {_FOLDER_RUNS} WHERE lang = 'fr' OR lang = 'en' AND even > 0) FROM {_FOLDER_RUNS} WHERE lang = 'fr'""")
def _st6c(t):
    """Two rescans of a folder that changes between them: what the catalog holds, and how many files each run has read."""
    root, move_on = _changing_folder(t)
    state, runs = new_dir(t.spark, "rescan-changes"), []
    for run in range(2):
        if run:
            move_on()
        read = jobs.rescan(t.spark, root, state, "*.csv")
        records = read_snapshot(t.spark, f"{jobs.rescan_state(state, root)}/catalog")
        runs.append(records.groupBy(F.regexp_extract("relative_path", r"lang=([^/]*)/", 1).alias("lang")).agg(F.sum("row_count").alias("rows")).select(
            F.lit(run).alias("run"), "lang", "rows", F.lit(read).cast("long").alias("files_read")))
    return runs[0].unionByName(runs[1])


@query("st7_two_phase_records", sql="""
SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS phase, CASE WHEN lang = 'en' THEN n_chars END AS content_chars FROM documents""")
def _st7(t):
    """Shallow records of all documents, and content records of some, in any order."""
    inbox = new_dir(t.spark, "phases")
    shallow = t.documents.select("doc_id", F.lit(0).alias("phase"), F.lit(None).cast("long").alias("content_chars"))
    content = t.documents.where("lang = 'en'").select("doc_id", F.lit(1).alias("phase"), F.col("n_chars").alias("content_chars"))
    content.coalesce(1).write.mode("append").parquet(inbox)
    shallow.coalesce(1).write.mode("append").parquet(inbox)
    stream = t.spark.readStream.schema(shallow.schema).option("maxFilesPerTrigger", "1").parquet(inbox)
    base = new_dir(t.spark, "records")
    jobs.upsert_stream(stream, base, ["doc_id"], new_dir(t.spark, "records-ck"), "append", rank="phase")
    return keyed.read(t.spark, base)


@query("st8_replayed_batches", sql="SELECT event_id, event_type FROM events")
def _st8(t):
    """Every micro-batch is handed to the sink twice; its files are the same as from once."""
    out = new_dir(t.spark, "replay")

    def twice(df, batch_id):
        jobs.write_batch(df, out, batch_id)
        jobs.write_batch(df, out, batch_id)

    jobs.run_batches(_events(t).select("event_id", "event_type"), twice, new_dir(t.spark, "replay-ck"))
    return t.spark.read.parquet(out).drop("batch_id")


@query("st9_drop_redelivered", sql="SELECT event_id, user_id, event_type FROM events")
def _st9(t):
    """Every alert is delivered twice."""
    twice = _events(t).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    once = jobs.drop_redelivered(twice, ["event_id"], "ts")
    return _appended(t, once.select("event_id", "user_id", "event_type"), "redelivered")
