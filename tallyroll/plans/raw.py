"""Raw inputs of the pipeline (JSON, OCR text, responses, events) derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir
from .fixtures import table


def receipt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``receipt_id, order_key`` of every receipt; reads the orders alone."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("receipt_id"), key.alias("order_key"))


def amount_text(amount: Column, style: Column) -> Column:
    """An amount as printed: eight styles, one of them unreadable."""
    grouped = F.format_number(amount, 2)
    return (
        F.when(style == 0, grouped)
        .when(style == 1, F.translate(grouped, ",.", ".,"))
        .when(style == 2, F.concat(F.lit("Rp "), F.translate(F.format_number(amount, 0), ",", ".")))
        .when(style == 3, amount.cast("string"))
        .when(style == 4, F.concat(F.lit("$"), grouped))
        .when(style == 5, F.concat(F.lit("₩"), F.format_number(amount, 0), F.lit("원")))
        .when(style == 6, F.concat(F.lit("abc "), grouped))
        .otherwise(F.concat(F.lit("£"), amount.cast("string")))
    )


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _pair(key: str, json: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), json)


def _object(*parts: Column) -> Column:
    """JSON object from its members; NULL members are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def snapshot(df: DataFrame, label: str) -> str:
    """A raw corpus written once to the shared folder; returns its path."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return path


def cord_raw(gt: DataFrame, notes: bool = True) -> DataFrame:
    """``receipt_id, order_key, ordinal, image, ground_truth, body``: lines as printed text.

    Amounts come in mixed styles and a single line is a bare object. With
    ``notes`` every 9th order has a text entry before its lines and every 23rd a
    null ``sub_total``. ``ground_truth`` wraps every second ``body``.
    """
    key = F.col("order_key")

    def line(i: Column, n: Column) -> Column:
        kind = (F.col("order_key") + n) % 5
        return _object(
            F.when(kind != 4, _pair("nm", _quoted(i["name"]))),
            F.when(kind == 0, F.lit('"cnt":""'))
            .when(kind == 1, F.lit('"cnt":"x2"'))
            .when(kind == 2, _pair("cnt", _quoted(i["quantity"].cast("string")))),
            F.when(kind != 3, _pair("unitprice", _quoted(amount_text(i["total"] / 2, key % 8)))),
            _pair("price", _quoted(amount_text(i["total"], key % 8))),
        )

    entries = F.transform("items", line)
    if notes:
        entries = F.concat(
            F.when(key % 9 == 0, F.array(F.lit('"note"'))).otherwise(
                F.array().cast("array<string>")
            ),
            entries,
        )
    menu = F.when(F.size("_entries") == 1, F.col("_entries")[0]).otherwise(_list(F.col("_entries")))
    sub = F.when(key % 23 == 0, F.lit("null" if notes else "{}")).otherwise(
        _object(
            F.when(key % 6 != 0, _pair("storenm", _quoted(F.col("store_name")))),
            _pair("subtotal_price", _quoted(F.col("_total"))),
        )
    )
    body = _object(
        _pair("menu", menu),
        _pair("sub_total", sub),
        _pair("total", _object(_pair("total_price", _quoted(F.col("_total"))))),
    )
    staged = gt.withColumns(
        {"_entries": entries, "_total": amount_text(F.col("total"), key % 8)}
    ).withColumn("body", body)
    return staged.select(
        "receipt_id",
        "order_key",
        key.alias("ordinal"),
        F.encode(key.cast("string"), "UTF-8").alias("image"),
        F.when(key % 2 == 0, _object(_pair("gt_parse", F.col("body"))))
        .otherwise(F.col("body"))
        .alias("ground_truth"),
        "body",
    )


def sroie_raw(gt: DataFrame) -> DataFrame:
    """``receipt_id, ordinal, image, parsed_data``: company, date and total with gaps and bad totals."""
    key = F.col("order_key")
    body = _object(
        F.when(key % 7 == 1, F.lit('"company":null'))
        .when(key % 7 == 2, F.lit('"company":"  "'))
        .when(key % 7 != 3, _pair("company", _quoted(F.concat(F.lit(" "), "store_name")))),
        F.when(key % 5 != 0, _pair("date", _quoted(F.concat("date", F.lit("T10:00"))))),
        F.when(key % 11 == 0, F.lit('"total":"12,50"'))
        .when(key % 11 == 1, F.lit('"total":""'))
        .when(key % 11 != 2, _pair("total", F.col("total").cast("string"))),
    )
    text = F.when(key % 29 == 0, F.lit("{broken")).when(key % 31 == 0, F.lit("")).otherwise(body)
    return gt.select(
        "receipt_id",
        key.alias("ordinal"),
        F.encode(key.cast("string"), "UTF-8").alias("image"),
        text.alias("parsed_data"),
    )


def receipt_json(gt: DataFrame, defects: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``receipt_id, order_key, json`` and ``keep``: receipts in the stored form; 15 of 16 orders carry one defect."""
    k = F.col("order_key") % 16 if defects else F.lit(0)

    def line(i: Column, n: Column) -> Column:
        return _object(
            _pair("line_number", F.when(k == 9, n).otherwise(n + 1).cast("string")),
            _pair("name", _quoted(i["name"])),
            F.when(k == 7, F.lit('"quantity":null')).otherwise(_pair("quantity", i["quantity"].cast("string"))),
            F.when(k == 8, F.lit('"unit":"box"')).otherwise(F.lit('"unit":"each"')),
            _pair("total", i["total"].cast("string")),
        )

    json = _object(
        F.when(k == 2, F.lit('"store":{}')).when(
            k != 1, _pair("store", _object(_pair("name", _quoted(F.col("store_name")))))
        ),
        F.when(k == 3, F.lit('"date":5')).when(k != 4, _pair("date", _quoted(F.col("date")))),
        F.when(k == 5, F.lit('"items":[]'))
        .when(k == 6, F.lit('"items":{}'))
        .otherwise(_pair("items", _list(F.transform("items", line)))),
        F.when(k == 10, F.lit('"total":"12"')).when(k != 11, _pair("total", F.col("total").cast("string"))),
        F.when(k == 12, F.lit('"currency":"usd"')).otherwise(F.lit('"currency":"USD"')),
        F.when(k == 13, F.lit('"payment":{"method":"barter"}'))
        .when(k == 14, F.lit('"metadata":{"source":"web"}'))
        .when(k == 15, F.lit('"loyalty":{"points_earned":true}')),
    )
    return gt.select("receipt_id", "order_key", json.alias("json"), *keep)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, response``: JSON answers plain, fenced, with trailing text, or none at all."""
    json = F.to_json(F.struct(F.col("text").alias("store"), F.col("conv_id").alias("total")))
    k = (F.col("conv_id") + F.col("turn")) % 6
    text = (
        F.when(k == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```\n")))
        .when(k == 1, json)
        .when(k == 2, F.concat(json, F.lit("\nHope this helps.")))
        .when(k == 3, F.concat(F.lit("```\n"), json))
        .when(k == 4, F.lit("[1, 2]"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("response"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``receipt_id, sequence``: decoded model output with task tags present, absent or cut."""
    key = F.col("o_orderkey")
    body = F.concat(F.lit('{"id":'), key.cast("string"), F.lit("}"))
    k = key % 5
    text = (
        F.when(k == 0, F.concat(F.lit('<s_cord-v2>{"cord-v2":'), body, F.lit("}</s_cord-v2></s>")))
        .when(k == 1, F.concat(F.lit("<s_receipt>"), body, F.lit("</s_receipt><pad><pad>")))
        .when(k == 2, body)
        .when(k == 3, F.concat(F.lit("noise <s_receipt>"), body))
        .otherwise(F.concat(F.lit("0123456789"), body, F.lit("</s_receipt>")))
    )
    return table(spark, sf_dir, "orders").select(key.alias("receipt_id"), text.alias("sequence"))


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: documents under a receipt-like header."""
    key = F.col("doc_id")
    price = F.format_number(key * 1.25 + 0.5, 2)
    k = key % 6
    head = (
        F.when(k == 0, F.concat(F.lit("12/03/2024\n\n  Corner Shop  \nTOTAL: $"), price, F.lit("\n")))
        .when(k == 1, F.concat(F.lit("Corner Shop\nSUBTOTAL 5.00\nTOTAL "), price, F.lit("\n")))
        .when(k == 2, F.concat(F.lit("\n 10:30 \nAmount due: "), price, F.lit("\n")))
        .when(k == 3, F.concat(F.lit("tea 3.50\nbread "), price, F.lit("\n")))
        .when(k == 4, F.concat(F.lit("Grand Total amount  "), price, F.lit("\n")))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))


# Queue states behind the event types.
STATES = {
    "view": "STARTED",
    "signup": "PENDING",
    "purchase": "SUCCESS",
    "error": "FAILURE",
    "click": "RETRY",
}


def event_state(event_type: Column) -> Column:
    state = F.lit(None).cast("string")
    for kind, name in STATES.items():
        state = F.when(event_type == kind, name).otherwise(state)
    return state


def job_events(events: DataFrame) -> DataFrame:
    """``event_id, job_id, ts, state, result`` from the event table or its stream."""
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        event_state(F.col("event_type")).alias("state"),
        F.col("props").alias("result"),
    )


def deliveries(events: DataFrame) -> DataFrame:
    """``task_id, ts``: every event once, and every 20th a second time a minute later."""
    waits = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(60))).otherwise(
        F.array(F.lit(0))
    )
    return events.select(
        F.col("event_id").alias("task_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.explode(waits).alias("wait"),
    ).select("task_id", F.timestamp_add("SECOND", F.col("wait"), F.col("at")).alias("ts"))


def uploads(documents: DataFrame) -> DataFrame:
    """``job_id, content_type, content``: documents as submitted files, one in eight no image."""
    key = F.col("doc_id")
    kind = F.when(key % 8 == 0, "text/plain").when(key % 8 == 1, "image/png").otherwise("image/jpeg")
    return documents.select(
        key.cast("string").alias("job_id"), kind.alias("content_type"), F.encode("text", "UTF-8").alias("content")
    )


def batched_stream(df: DataFrame, key: str, path: str, files: int = 4) -> DataFrame:
    """A table written as ``files`` files by hash of ``key``, and read as a stream of one file a batch."""
    df.repartition(files, key).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def submissions(events: DataFrame) -> DataFrame:
    """``job_id, content, ts``: every event is a submission; the image says how many tries fail (9: all)."""
    key = F.col("event_id")
    fails = F.when(key % 50 == 7, 9).when(key % 10 == 3, 1).when(key % 10 == 5, 2).when(key % 100 == 9, 3).otherwise(0)
    return events.select(
        key.alias("job_id"), F.encode(F.concat(fails.cast("string"), F.lit("|"), "event_type"), "UTF-8").alias("content"),
        F.col("ts").cast("timestamp").alias("ts"))


def timed_stream(
    df: DataFrame, time: str, path: str, batches: int, closing: int, rows_per_file: int = 250_000
) -> DataFrame:
    """A table as a stream of ``batches`` batches in order of time, and ``closing`` later ones without a key, an hour apart.

    The closing rows stand for the traffic that goes on and moves the clock. All
    batches have the same number of files, which grows with the table.
    """
    spark = df.sparkSession
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count(time).alias("n")).first()
    files = max(1, ends.n // (batches * rows_per_file))
    at = F.floor((F.unix_micros(time) - F.unix_micros(F.lit(ends.a))) * batches / (
        F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)) + 1))
    for i in range(batches):
        df.filter(at == i).repartition(files).write.mode("append").parquet(path)
    for i in range(1, closing + 1):
        late = spark.range(0, files, 1, files).select(*[
            F.timestamp_add("HOUR", F.lit(i), F.lit(ends.b)).alias(f.name) if f.name == time
            else (-(F.lit(i) + F.col("id") * closing).cast(f.dataType) if f.name == "job_id" else F.lit(b"0|tick").cast(f.dataType)).alias(f.name)
            for f in df.schema.fields])
        late.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
