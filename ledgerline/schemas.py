"""Record layouts, as Spark schemas, and the type names used for inferred tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, DATE = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Field names and types of the records and tables that are exchanged.
#: Path from a search response to its array of records.
RECORD_PATH = ("FHRSEstablishment", "EstablishmentCollection", "EstablishmentDetail")
SOURCE_RECORD = T.StructType(
    [T.StructField(n, S) for n in ("FHRSID LocalAuthorityBusinessID BusinessName BusinessType BusinessTypeID AddressLine1 AddressLine2 AddressLine3 AddressLine4 PostCode RatingValue RatingKey RightToReply RatingDate LocalAuthorityCode LocalAuthorityName LocalAuthorityWebSite LocalAuthorityEmailAddress").split()]
    + [T.StructField("Scores", _schema(Hygiene=S, Structural=S, ConfidenceInManagement=S)), T.StructField("SchemeType", S), T.StructField("NewRatingPending", S)]
    + [T.StructField("Geocode", _schema(Longitude=S, Latitude=S)), T.StructField("Distance", S)]
)
KEEP_COLUMNS = ["FHRSID", "BusinessName", "AddressLine1", "AddressLine2", "AddressLine3", "PostCode", "LocalAuthorityName", "RatingValue", "NewRatingPending", "first_seen", "manual_review", "gemini_insights"]
MASTER = _schema(fhrsid=S, businessname=S, addressline1=S, addressline2=S, addressline3=S, postcode=S, localauthorityname=S, ratingvalue=S, newratingpending=B, first_seen=DATE, manual_review=S, gemini_insights=S)
APPEND = _schema(
    fhrsid=S, localauthoritybusinessid=S, businessname=S, businesstype=S, businesstypeid=L, addressline1=S, addressline2=S, addressline3=S, addressline4=S, postcode=S, ratingvalue=S, ratingkey=S, ratingdate=S,
    localauthoritycode=S, localauthorityname=S, localauthoritywebsite=S, localauthorityemailaddress=S, scoreshygiene=L, scoresstructural=L, scoresconfidenceinmanagement=L, schemetype=S, geocodelongitude=D, geocodelatitude=D,
    newratingpending=B, first_seen=DATE, manual_review=S,
)
FULL_WRITE = _schema(
    fhrsid=S, businessname=S, addressline1=S, addressline2=S, addressline3=S, postcode=S, ratingvalue=S, ratingkey=S, ratingdate=S, localauthorityname=S, scoreshygiene=L, scoresstructural=S, scoresconfidenceinmanagement=S,
    schemetype=S, newratingpending=B, geocodelongitude=D, geocodelatitude=D, first_seen=DATE, manual_review=S, gemini_insights=S,
)
#: The columns that a full write selects before their names are sanitised.
FULL_WRITE_COLUMNS = [
    "FHRSID", "BusinessName", "AddressLine1", "AddressLine2", "AddressLine3", "PostCode", "RatingValue", "RatingKey", "RatingDate", "LocalAuthorityName",
    "Scores.Hygiene", "Scores.Structural", "Scores.ConfidenceInManagement", "SchemeType", "NewRatingPending", "Geocode.Latitude", "Geocode.Longitude", "first_seen", "manual_review", "gemini_insights",
]
INSIGHTS = ["fhrsid", "businessname", "addressline1", "addressline2", "addressline3", "postcode", "gemini_insights"]
NOT_REVIEWED = "not reviewed"


def type_name(kind: T.DataType) -> str:
    """INTEGER, FLOAT, BOOLEAN, TIMESTAMP or, for everything else, STRING."""
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "FLOAT"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return "STRING"


def infer_schema(schema: T.StructType) -> list[tuple[str, str]]:
    """(column, type name) in column order."""
    return [(f.name, type_name(f.dataType)) for f in schema.fields]
