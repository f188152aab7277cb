"""Raw inputs as records: sale CSV files, source feature rows in JSON, detail pages in HTML; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import dates, postcode, text


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; quotes, doubled quotes and line breaks within quotes are understood, blank rows dropped."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding=encoding, ignoreLeadingWhiteSpace=True, inferSchema=False)
    return rows.dropna("all")


def header(columns: list[str], name: str, prefix: str | None = None) -> str | None:
    """The column of a name, or else the first that begins with a prefix, whatever the case."""
    found = [c for c in columns if c.strip().lower() == name.lower()]
    if not found and prefix:
        found = [c for c in columns if c.strip().lower().startswith(prefix.lower())]
    return found[0] if found else None


def sale_records(raw: DataFrame) -> DataFrame:
    """Sale records of raw rows; rows without a date, a price or an address go."""

    def col(name: str, prefix: str | None = None):
        found = header(raw.columns, name, prefix)
        return F.col(f"`{found}`") if found else F.lit(None).cast("string")

    address, county, code, what = col("Address"), col("County"), col("Eircode"), col("Description of Property")
    rows = raw.select(
        dates.day_month_year(col("Date of Sale (dd/mm/yyyy)", "date of sale")).alias("date_of_sale"),
        F.btrim(address).alias("address_raw"),
        text.normalised_address(address).alias("address_normalised"),
        text.locality_of(address, county).alias("locality"),
        F.btrim(county).alias("county"),
        postcode.first_valid(code, address).alias("eircode"),
        text.price(col("Price", "price")).alias("price_eur"),
        text.flag(col("VAT Exclusive")).alias("vat_exclusive"),
        text.new_dwelling(what).alias("is_new_dwelling"),
        text.squeeze(what).alias("property_description_raw"),
        text.record_hash(*(F.col(f"`{c}`") for c in raw.columns)).alias("source_row_hash"),
    )
    sound = F.col("date_of_sale").isNotNull() & (F.col("price_eur") > 0) & (F.col("address_raw") != "")
    slug = F.coalesce(F.nullif(text.slug(F.col("locality")), F.lit("")), text.slug(F.col("county")))
    return rows.where(sound).withColumns({"area_slug": slug, "eircode_prefix": postcode.routing_key(F.col("eircode")), "year": F.year("date_of_sale"), "month": F.month("date_of_sale")})


def insert_new(target: DataFrame, incoming: DataFrame, key: str = "source_row_hash") -> DataFrame:
    """Incoming rows whose key the target has not; of equal keys one."""
    return incoming.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both, of each key the one that is latest by `order`; incoming ones win ties."""
    from parcelflow.operators.planning import latest_by_key

    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_by_key(both, keys, [F.desc_nulls_last(order), F.desc("_new")]).drop("_new")


def fill_nulls(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The old rows with missing fields taken from the new ones."""
    extra = new.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return old.join(extra, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in old.columns))


def feature_records(raw: DataFrame) -> DataFrame:
    """Applications of source feature rows: dates from epoch milliseconds, names joined, blanks to null."""
    day = {"ReceivedDate": "registration_date", "DecisionDate": "decision_date", "GrantDate": "final_grant_date", "WithdrawnDate": "withdrawal_date"}
    return raw.select(
        text.squeeze(F.col("ApplicationNumber")).alias("reference"),
        text.squeeze(F.col("PlanningAuthority")).alias("authority"),
        text.squeeze(F.col("DevelopmentDescription")).alias("proposal"),
        text.squeeze(F.col("DevelopmentAddress")).alias("location"),
        text.squeeze(F.concat_ws(" ", "ApplicantForename", "ApplicantSurname")).alias("applicant_name"),
        text.squeeze(F.col("ApplicationStatus")).alias("status"),
        *(dates.epoch_day(F.col(source)).alias(name) for source, name in day.items()),
    )


def detail_fields(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, label and value of the header and data cells of each page; blank values are null."""
    return pages.select("page_id", F.explode(text.table_fields(F.col(html_col))).alias("label", "value"))


def sitemap(urls: DataFrame, loc: str, lastmod: str) -> DataFrame:
    """One XML line for each address."""
    entry = F.concat(F.lit("<url><loc>"), text.xml_escape(F.col(loc)), F.lit("</loc><lastmod>"), F.date_format(lastmod, "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    return urls.select(F.col(loc), entry.alias("entry"))
