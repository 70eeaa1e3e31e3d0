"""Joins, windows, sorts, set operations and writes of the prospecting model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import filled


def contact_companies(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    return contacts.join(companies.select("company_id", F.col("name").alias("company"), "domain"), "company_id", "left")


def recipients(emails: DataFrame, contacts: DataFrame) -> DataFrame:
    """The mail's own recipient, else the contact's address."""
    return emails.join(contacts.select("contact_id", "email", "full_name"), "contact_id", "left")


def active_contacts(contacts: DataFrame, companies: DataFrame, searches: DataFrame) -> DataFrame:
    """Contacts whose company's search is active or completed."""
    live = searches.where(F.col("status").isin("active", "completed")).select("search_id")
    return contacts.join(companies.select("company_id", "search_id").join(live, "search_id", "left_semi"), "company_id", "left_semi")


def without_paused(emails: DataFrame, contacts: DataFrame) -> DataFrame:
    return emails.join(contacts.where("paused").select("contact_id"), "contact_id", "left_anti")


def uncovered(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    return companies.join(contacts.select("company_id"), "company_id", "left_anti")


def mark_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with known: whether their key was there before; all rows stay, so both kinds can be counted."""
    return rows.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_per_key(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key; rows without a key all stay, and pass by the window."""
    keyed = rows.withColumn("_key", key)
    first = keyed.where(F.col("_key").isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_nth = 1")
    return first.drop("_key", "_nth").union(keyed.where(F.col("_key").isNull()).drop("_key"))


def dedup_counters(rows: DataFrame, known: DataFrame, key: str, relink: bool = True) -> DataFrame:
    """rows kept, duplicates within the batch, keys known before, and rows dropped; relink: known rows stay.

    One row stays of a key at most, so counts a key are enough: they combine before the shuffle, the keyless ones, too.
    """
    marked = mark_known(rows.groupBy(key).agg(F.count("*").alias("_n")), known, key)
    has = F.col(key).isNotNull()
    kept = F.count_if(has & (F.lit(relink) | ~F.col("known")))
    out = [kept.alias("kept"), F.coalesce(F.sum(F.when(has, F.col("_n") - 1)), F.lit(0)).alias("batch_duplicates"), F.count_if(has & F.col("known")).alias("known_duplicates"), (F.coalesce(F.sum("_n"), F.lit(0)) - kept).alias("dropped")]
    return marked.agg(*out)


def cap_per_group(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """At most cap rows of each group in arrival order; Spark cuts groups to cap rows before the shuffle, too."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= cap)


def best_per_key(rows: DataFrame, key: list[str], best: list, value: list[str]) -> DataFrame:
    """The largest by `best` of each key, by an aggregate that combines before the shuffle."""
    return rows.groupBy(*key).agg(F.max(F.struct(*best, *value)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in value])


def distinct_mail_per_company(contacts: DataFrame) -> DataFrame:
    """Later holders of an address within a company lose it and fall back to their profile as the channel."""
    nth = F.row_number().over(Window.partitionBy("company_id", "email").orderBy("contact_id"))
    ranked = contacts.withColumn("_nth", F.when(filled(F.col("email")), nth))
    mail = F.when(F.col("_nth") == 1, F.col("email"))
    return ranked.select("contact_id", "company_id", mail.alias("email"), F.when(mail.isNotNull(), "email").when(filled(F.col("linkedin_url")), "linkedin").alias("channel"))


#: Rows of the sample that stand for one bucket of a sort.
SAMPLED = 32


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their rank, from 1, by `order`: ascending columns, nulls first, that end in an identifier.

    Rows are dealt to as many buckets as there are shuffle partitions, between splitters of a sample that is drawn by the hash
    of the key, so that every evaluation draws the same; a rank is the count of the buckets before plus the place in its own.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(buckets * SAMPLED)
    splitters = F.filter(F.array_sort(F.collect_list("_key")), lambda _, i: i % SAMPLED == SAMPLED - 1)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at("_splitters", at + step) <= F.col("_key"), at + step).otherwise(at))
    dealt = keyed.crossJoin(F.broadcast(sample.agg(splitters.alias("_splitters")))).withColumn("_bucket", below).drop("_splitters")  # one row
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))  # a row a bucket
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    out = dealt.withColumn("_nth", nth).join(F.broadcast(sizes.select("_bucket", before.alias("_before"))), "_bucket")
    return out.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("rank"))


#: The last row of a page up to which one task may hold all rows before it.
NEAR = 10_000


def page(rows: DataFrame, order: list, number: int, size: int, keys: list[Column] | None = None) -> DataFrame:
    """A page by its number; keys: the same order as ascending columns, by which a page far down is taken from the ranks of all
    rows, so that no task gets what stands before it."""
    if number * size <= NEAR or not keys:
        return rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return ranked(rows, keys).where(F.col("rank").between((number - 1) * size + 1, number * size)).drop("rank")


def page_info(rows: DataFrame, number: int, size: int) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long")
    return rows.agg(F.count("*").alias("n")).select("n", pages.alias("pages"), (F.lit(number) < pages).alias("has_more"))


def union_first(first: DataFrame, second: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of both, those of first winning by key."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    return both.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("_source", *order))).where("_nth = 1").drop("_source", "_nth")


def merge_seeds(directory: DataFrame, web: DataFrame) -> DataFrame:
    """Outer merge on domain: the directory's values win, the web fills what is missing, directory rows come first."""
    d = directory.select("domain", F.col("title").alias("d_title"), F.col("snippet").alias("d_snippet"), F.col("ord").alias("d_ord"))
    w = web.select("domain", F.col("title").alias("w_title"), F.col("snippet").alias("w_snippet"), F.col("ord").alias("w_ord"))
    out = d.join(w, "domain", "full")
    return out.select("domain", F.coalesce("d_title", "w_title").alias("title"), F.coalesce(F.nullif(F.col("d_snippet"), F.lit("")), "w_snippet").alias("snippet"), F.when(F.col("d_ord").isNotNull(), "directory").otherwise("web").alias("source"), F.coalesce("d_ord", "w_ord").alias("ord"))


def quotas(rows: DataFrame, source: str, weight: str, total: int, order: list) -> DataFrame:
    """Of each active source, its weighted share of total: at least one row, rounded up."""
    shares = rows.select(source, weight).distinct()
    sums = shares.agg(F.sum(weight).alias("_sum"))  # one row
    quota = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.col("_sum") * total))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return ranked.join(shares.crossJoin(F.broadcast(sums)).select(F.col(source), quota.alias("quota")), source).where(F.col("nth") <= F.col("quota"))


def upsert(target: DataFrame, changes: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
    """Changes overwrite all columns but those in `kept`, which an existing row keeps; new keys are added."""
    t, c = target.alias("t"), changes.alias("c")
    on = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in key]
    joined = t.join(c, on, "full")
    there, changed = F.col(f"t.{key[0]}").isNotNull(), F.col(f"c.{key[0]}").isNotNull()
    return joined.select(*[F.when(changed & ~(there & F.lit(n in kept)), F.col(f"c.{n}")).otherwise(F.col(f"t.{n}")).alias(n) for n in target.columns])


def guarded_update(rows: DataFrame, guard: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({name: F.when(guard, value).otherwise(F.col(name)) for name, value in values.items()})


def soft_delete(contacts: DataFrame, discard: Column) -> DataFrame:
    """Discarded rows stay with their mark and without address, profile and score."""
    return guarded_update(contacts, discard, {"discarded": F.lit(True), "email": F.lit(None), "linkedin_url": F.lit(None), "lead_score": F.lit(None), "channel": F.lit(None), "email_status": F.lit(None)})


def replies_to_mails(replies: DataFrame, sent: DataFrame, span: str = "day") -> DataFrame:
    """The first reply of each sent mail: same person, after it was sent.

    Both sides go through one sort a person and span of time, latest first; a mail takes the last reply that has passed by, so
    no mail meets every later reply, and a person with very many of both is many tasks' work.  A mail without a reply in its own
    span takes the first of the next span that has one, carried back over the spans of its person.  At equal times a mail
    comes before a reply, which is not after it.
    """
    nobody = F.lit(None).cast("long")
    mails = sent.select("person", F.col("sent_at").alias("at"), F.lit(0).alias("kind"), F.col("mail_id").cast("long").alias("mail_id"), nobody.alias("reply_id"))
    answers = replies.select("person", F.col("reply_at").alias("at"), F.lit(1).alias("kind"), nobody.alias("mail_id"), F.col("reply_id").cast("long").alias("reply_id"))
    both = mails.union(answers).where(F.col("person").isNotNull()).withColumn("span", F.date_trunc(span, "at"))
    passed = Window.partitionBy("person", "span").orderBy(F.desc("at"), "kind", F.desc("reply_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("reply_id", F.last("reply_id", ignorenulls=True).over(passed)).where("kind = 0").select("person", "span", "mail_id", "reply_id")
    spans = both.groupBy("person", "span").agg(F.min(F.when(F.col("kind") == 1, F.struct("at", "reply_id")))["reply_id"].alias("own"))
    later = Window.partitionBy("person").orderBy("span").rowsBetween(1, Window.unboundedFollowing)  # a row a span
    next_ = spans.withColumn("next", F.first("own", ignorenulls=True).over(later)).where(F.col("next").isNotNull()).select("person", "span", "next")
    found = met.where(F.col("reply_id").isNotNull()).select("mail_id", "reply_id")
    return found.union(met.where(F.col("reply_id").isNull()).join(next_, ["person", "span"]).select("mail_id", F.col("next").alias("reply_id")))
