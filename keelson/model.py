"""The object model: one columnar table per family of index rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

#: Schemas of all tables. Object types and claim types are fixed values.
SCHEMAS = {
    "blob_meta": "ref string, size bigint, camli_type string",
    "claims": "claim_ref string, permanode string, signer string, date timestamp, ctype string, attr string, value string",
    "signers": "signer string, key_id string",
    "deletions": "target string, deleter string",
    "files": "file_ref string, file_name string, size bigint, mime string, time timestamp, mod_time timestamp, whole_ref string",
    "images": "file_ref string, width int, height int",
    "media_tags": "whole_ref string, tag string, value string",
    "exif_gps": "whole_ref string, lat double, long double",
    "dir_children": "dir_ref string, child_ref string",
    "paths": "signer string, base string, suffix string, date timestamp, claim_ref string, active boolean, target string",
}

CAMLI_TYPES = ("bytes", "claim", "directory", "fifo", "file", "inode", "keep", "permanode", "share", "socket", "static-set", "symlink")
CLAIM_TYPES = ("set-attribute", "add-attribute", "del-attribute", "share", "delete")
#: Attributes that the attribute lookup serves.
INDEXED_ATTRS = ("camliRoot", "camliImportRoot", "tag", "title")
#: Attributes that are read as the time of an object, in this order, before and after the file's times.
TIME_ATTRS_BEFORE_FILE = ("paymentDueDate", "startDate", "dateCreated")
TIME_ATTRS_AFTER_FILE = ("datePublished", "dateModified")
VENUE = "foursquare.com:venue"
#: Objects of a type may have the place of an object that an attribute refers to: a fixed value.
PLACE_OF = {"foursquare.com:checkin": "foursquareVenuePermanode"}


@dataclass
class Store:
    """The tables of one object store, as DataFrames of the schemas above."""

    blob_meta: DataFrame
    claims: DataFrame
    signers: DataFrame
    deletions: DataFrame
    files: DataFrame
    images: DataFrame
    media_tags: DataFrame
    exif_gps: DataFrame
    dir_children: DataFrame
    paths: DataFrame
    #: Key whose claims count; attributes of other keys are invisible to queries.
    owner_key: str = "ka"
    #: Views of this snapshot that were made once, by name.
    views: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A view of the snapshot, made at its first use; tables never change, so neither does it."""
        if name not in self.views:
            self.views[name] = make()
        return self.views[name]

    @property
    def spark(self) -> SparkSession:
        return self.blob_meta.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, owner_key: str = "ka", **tables: DataFrame) -> Store:
        """A store of the given tables; those not given are empty."""
        return cls(**{f.name: tables[f.name] if f.name in tables else spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(cls) if f.name in SCHEMAS}, owner_key=owner_key)

    def save(self, folder: str) -> None:
        """Write all tables as Parquet in files of even size.

        Blob metadata is partitioned by type, and claims are sorted by attribute
        within files, so that queries skip what they do not ask for.
        """
        for name in SCHEMAS:
            df = getattr(self, name).hint("rebalance")
            if name == "claims":
                df = df.sortWithinPartitions("attr", "permanode")
            (df.write.partitionBy("camli_type") if name == "blob_meta" else df.write).mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, owner_key: str = "ka") -> Store:
        tables = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
        # an empty type comes back from its partition as null
        tables["blob_meta"] = tables["blob_meta"].selectExpr("ref", "size", "coalesce(camli_type, '') as camli_type")
        return cls(**tables, owner_key=owner_key)
