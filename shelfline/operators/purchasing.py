"""Purchase orders as tables: drafting, numbering, states, updates, listings, exports."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordering import row_numbers
from .inventory import latest_by_sku, sku_state

# fixed values: states each state may follow
ALLOWED_FROM = {"drafted": (), "approved": ("drafted",), "placed": ("approved",), "received": ("placed",),
                "cancelled": ("drafted", "approved", "placed")}
ALLOWED_PAIRS = tuple(f"{a}>{b}" for b, before in ALLOWED_FROM.items() for a in before)


def draft_pos(lines: DataFrame, df: DataFrame, sup: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Draft headers and lines from (draft_id, line_no, sku_id, qty).

    Unknown SKUs are dropped and named in the notes.  Supplier and needed-by date come
    from the first valid line; amounts are summed before drafts are put together."""
    st = sku_state(df).select("sku_id", F.col("last_supplier").alias("_sup"), F.col("last_unit_cost").alias("unit_cost"),
                              F.col("known_lead_time_days").alias("_lt"))
    j = lines.select("draft_id", "line_no", F.upper(F.trim("sku_id")).alias("sku_id"), "qty").join(
        st.withColumn("_known", F.lit(True)), "sku_id", "left")
    ok = F.col("_known").isNotNull()
    first = F.min(F.when(ok, F.struct("line_no", "_sup", "_lt")))
    head = j.groupBy("draft_id").agg(
        first.alias("_f"), F.sum(F.when(ok, F.col("qty"))).alias("total_units"),
        F.sum(F.when(ok, F.col("qty") * F.coalesce("unit_cost", F.lit(0.0)))).alias("total_cost"),
        F.array_join(F.sort_array(F.collect_set(F.when(~ok, F.col("sku_id")))), ", ").alias("_skipped"))
    head = head.where(F.col("_f").isNotNull()).join(
        sup.select(F.col("name").alias("_n"), "supplier_id"), F.col("_f._sup") == F.col("_n"), "left")
    days = F.floor(F.coalesce("_f._lt", F.lit(14.0))).cast("int") + 7
    head = head.select("draft_id", "supplier_id", F.lit("drafted").alias("status"), F.date_add(F.lit(as_of).cast("date"), days).alias("needed_by"),
                       "total_cost", "total_units",
                       F.when(F.col("_skipped") != "", F.concat(F.lit("skipped invalid SKUs: "), F.col("_skipped"))).alias("notes"))
    return head, j.where(ok).select("draft_id", "sku_id", "qty", "unit_cost")


def number_pos(drafts: DataFrame, year: int, existing: int, key: str = "draft_id") -> DataFrame:
    """PO-{year}-{running number of five digits} in key order."""
    n = row_numbers(drafts, [F.asc(key)], "_n")
    num = F.col("_n") + existing
    return n.withColumn("po_id", F.concat(F.lit(f"PO-{year}-"), F.when(num > 99999, num.cast("string"))
                                          .otherwise(F.lpad(num.cast("string"), 5, "0")))).drop("_n")


def po_state(log: DataFrame) -> DataFrame:
    """Current state of each order: the last status by time, with counts before the exchange."""
    return log.groupBy("po_id").agg(F.max_by("to_status", F.struct("at", "to_status")).alias("status"),
                                    F.max("at").alias("since"), F.count(F.lit(1)).alias("n_events"))


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Events whose predecessor does not allow them."""
    w = W.partitionBy("po_id").orderBy("at", "to_status")
    prev = log.withColumn("previous", F.lag("to_status").over(w))
    fine = F.when(F.col("previous").isNull(), F.col("to_status") == "drafted").otherwise(
        F.concat("previous", F.lit(">"), "to_status").isin(*ALLOWED_PAIRS))
    return prev.where(~fine).select("po_id", "previous", "to_status", "at")


def apply_updates(po: DataFrame, upd: DataFrame) -> DataFrame:
    """Field updates by order; null leaves a field, an empty string clears it."""
    cols = ("assigned_to", "approved_by", "notes")
    u = upd.select("po_id", *[F.col(c).alias(f"_{c}") for c in cols])
    return po.join(u, "po_id", "left").withColumns({
        c: F.when(F.col(f"_{c}").isNull(), F.col(c)).when(F.col(f"_{c}") != "", F.col(f"_{c}")) for c in cols
    }).drop(*[f"_{c}" for c in cols])


def list_pos(po: DataFrame, lines: DataFrame, log: DataFrame, sup: DataFrame, status: str | None = None) -> DataFrame:
    """Orders newest first with nested lines and log; the status filter comes before the joins."""
    head = po if status is None else po.where(F.col("status") == status)
    keys = head.select("po_id")
    l = lines.join(keys, "po_id", "left_semi").groupBy("po_id").agg(
        F.sort_array(F.collect_list(F.struct("sku_id", "qty", "unit_cost"))).alias("lines"))
    g = log.join(keys, "po_id", "left_semi").groupBy("po_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "from_status", "to_status", "by_user"))).alias("status_log"))
    return (head.join(sup.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id", "left")
            .join(l, "po_id", "left").join(g, "po_id", "left").orderBy(F.desc("created_at"), "po_id"))


def delete_pos(ids: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(t.join(ids.select("po_id"), "po_id", "left_anti") for t in tables)


def accept_plan(lines: DataFrame, df: DataFrame, sup: DataFrame, as_of: str) -> DataFrame:
    """Every proposed draft with its outcome: created, or the reason it failed."""
    head, _ = draft_pos(lines, df, sup, as_of)
    asked = lines.select("draft_id").distinct()
    return asked.join(head, "draft_id", "left").select(
        "draft_id", F.when(F.col("status").isNull(), "failed").otherwise("created").alias("outcome"),
        F.when(F.col("status").isNull(), "no valid SKUs in line list").alias("error"), "supplier_id", "total_cost")


def export_rows(po: DataFrame, lines: DataFrame, sup: DataFrame) -> DataFrame:
    cost = F.coalesce("unit_cost", F.lit(0.0))
    return (lines.join(po.select("po_id", "supplier_id", "needed_by", "status", "expedite_flag"), "po_id")
            .join(sup.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id", "left")
            .select("po_id", F.coalesce("supplier_id", F.lit("")).alias("supplier_id"),
                    F.coalesce("supplier_name", F.lit("")).alias("supplier_name"), "needed_by", "sku_id", "qty",
                    cost.alias("unit_cost"), (cost * F.col("qty")).alias("line_total"),
                    F.when(F.col("expedite_flag"), "Y").otherwise("N").alias("expedite"), "status"))


# default interchange ids
SENDER, RECEIVER = "BUYER", "VENDOR"


def export_edi850(po: DataFrame, lines: DataFrame, sup: DataFrame, as_of: str, sender: str = SENDER,
                  receiver: str = RECEIVER) -> DataFrame:
    """X12 850 text of every order: (po_id, body)."""
    ts = F.lit(as_of).cast("timestamp")
    day6, day8, hm = (F.date_format(ts, p) for p in ("yyMMdd", "yyyyMMdd", "HHmm"))
    tail = F.replace(F.col("po_id"), F.lit("-"), F.lit(""))
    ctrl = F.lpad(F.substring(tail, F.greatest(F.lit(1), F.length(tail) - 8), F.lit(9)), 9, "0")
    pad = lambda s: (s + " " * 15)[:15]
    # an order's lines are bounded by its SKUs
    l = lines.groupBy("po_id").agg(F.sort_array(F.collect_list(F.struct("sku_id", "qty", "unit_cost"))).alias("_l"))
    j = po.join(l, "po_id", "left").join(sup.select(
        "supplier_id", F.col("name").alias("_name"), F.col("contact_email").alias("_mail"), F.col("country").alias("_land")),
        "supplier_id", "left")
    items = F.transform(F.coalesce("_l", F.array()), lambda x, i: F.concat(
        F.lit("PO1*"), (i + 1).cast("string"), F.lit("*"), F.rint(x["qty"]).cast("long").cast("string"), F.lit("*EA*"),
        F.format_string("%.2f", F.coalesce(x["unit_cost"], F.lit(0.0))), F.lit("**VP*"), x["sku_id"]))
    head = F.filter(F.array(
        F.concat(F.lit(f"ISA*00*{' ' * 10}*00*{' ' * 10}*ZZ*{pad(sender)}*ZZ*{pad(receiver)}*"), day6, F.lit("*"), hm,
                 F.lit("*U*00401*"), ctrl, F.lit("*0*P*>")),
        F.concat(F.lit(f"GS*PO*{sender}*{receiver}*"), day8, F.lit("*"), hm, F.lit("*1*X*004010")),
        F.lit("ST*850*0001"), F.concat(F.lit("BEG*00*SA*"), F.col("po_id"), F.lit("**"), day8),
        F.when(F.col("_mail") != "", F.concat(F.lit("REF*EM*"), F.col("_mail"))),
        F.when(F.col("needed_by").isNotNull(), F.concat(F.lit("DTM*002*"), F.date_format("needed_by", "yyyyMMdd"))),
        F.when(F.col("_name").isNotNull(), F.concat(F.lit("N1*VN*"), F.col("_name"))),
        F.when(F.col("_land") != "", F.concat(F.lit("N4***"), F.col("_land")))), lambda x: x.isNotNull())
    j = j.select("po_id", F.concat(head, items).alias("_s"), F.size(items).alias("_n"), ctrl.alias("_c"))
    end = F.array(F.concat(F.lit("CTT*"), F.col("_n").cast("string")),
                  F.concat(F.lit("SE*"), (F.size("_s") + 2).cast("string"), F.lit("*0001")), F.lit("GE*1*1"),
                  F.concat(F.lit("IEA*1*"), F.col("_c")))
    return j.select("po_id", F.concat(F.array_join(F.concat("_s", end), "~\n"), F.lit("~\n")).alias("body"))


def write_edi850(docs: DataFrame, path: str) -> None:
    docs.select(F.col("body").alias("value")).write.mode("overwrite").text(path)
