"""The fixed 44-column record: names, kinds and code dictionaries.

Zero is the null of every number and code, the empty string that of every text.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Columns by position, each with how its text becomes a value.
# "date" is YYYYMMDD as a number, "code:x" an entry of the dictionary x.
COLUMNS = {
    "summons_number": "u64",
    "plate_id": "text",
    "registration_state": "code:state",
    "plate_type": "code:plate_type",
    "issue_date": "date",
    "violation_code": "u16",
    "vehicle_body_type": "text",
    "vehicle_make": "text",
    "issuing_agency": "code:agency",
    "street_code1": "u32",
    "street_code2": "u32",
    "street_code3": "u32",
    "vehicle_expiration_date": "date",
    "violation_location": "text",
    "violation_precinct": "u16",
    "issuer_precinct": "u16",
    "issuer_code": "u32",
    "issuer_command": "text",
    "issuer_squad": "code:squad",
    "violation_time": "text",
    "time_first_observed": "text",
    "violation_county": "code:county",
    "violation_front_opposite": "code:front_opposite",
    "house_number": "text",
    "street_name": "text",
    "intersecting_street": "text",
    "date_first_observed": "date",
    "law_section": "u16",
    "sub_division": "text",
    "violation_legal_code": "code:legal_code",
    "days_parking_in_effect": "text",
    "from_hours_in_effect": "text",
    "to_hours_in_effect": "text",
    "vehicle_color": "text",
    "unregistered_vehicle": "code:unreg_vehicle",
    "vehicle_year": "u16",
    "meter_number": "text",
    "feet_from_curb": "u16",
    "violation_post_code": "text",
    "violation_description": "text",
    "no_standing_stopping": "text",
    "hydrant_violation": "text",
    "double_parking": "text",
    "fiscal_year": "u16",
}
#: Rows with fewer fields are rejected; a missing last one (fiscal_year) is zero.
LEAST_FIELDS = 43
MOST_FIELDS = 48

# A code's number is its place in its dictionary, from 1; 0 is unknown.
DICTIONARIES = {
    "county": "MN BK QN BX SI",
    "agency": "V T S P K Y O A M 8 L R N 9 C F 3 G X W 4 Q 1 U E",
    "front_opposite": "F O I R X",
    "legal_code": "T",
    "unreg_vehicle": "0",
    "state": "NY NJ PA FL CT VA MA GA NC MD IN TX IL OH CA AZ SC 99 ME TN AL DE MI RI MN WA VT MS NH CO MO WI OK ON SD OR KY LA MT DC "
    "WV UT AR NV KS IA NE NM ID DP WY ND AK PR GV HI AB NB BC PE NS MB FO QB QC",
    "plate_type": "PAS COM OMT OMS SRF MOT 999 ORG APP SPO MED PSD OMR TRC RGL CMB TOW SCL OML VAS IRP LMB ITP SRN TRL HIS OMV DLR "
    "TRA STA MCL TMP ORC LMA PHS AMB RGC SPC AGR SOS NYS NLM HAM LTR BOB ATV VPL STG SEM PPH MCD LUA CMH CHC CCK CBS AYG USC THC "
    "HSM HIR FAR CSP CME AGC",
    "squad": "A B C D E F G H I J K L M N O P Q R S T U V X Y Z 0000 AA BB CC DD EE FF GG HH PP YP YA X1 X2 B2 A2",
}
# Display names of the text columns, in column order.
TEXT_NAMES = [
    "Plate ID", "Vehicle Body Type", "Vehicle Make", "Violation Location", "Issuer Command", "Violation Time", "Time First Observed",
    "House Number", "Street Name", "Intersecting Street", "Sub Division", "Days Parking In Effect", "From Hours In Effect",
    "To Hours In Effect", "Vehicle Color", "Meter Number", "Violation Post Code", "Violation Description",
    "No Standing or Stopping Violation", "Hydrant Violation", "Double Parking Violation",
]
NULL_DATES = ("", "0", "00000000", "88888888")

_TYPES = {"u64": T.DecimalType(20, 0), "u32": T.LongType(), "u16": T.IntegerType(), "date": T.LongType(), "text": T.StringType()}
#: A code column keeps its number; the text it came from stands beside it.
RAW_SUFFIX = "_raw"


def record_type() -> T.StructType:
    fields = [T.StructField("row_id", T.LongType(), False)]
    for name, kind in COLUMNS.items():
        if kind.startswith("code:"):
            fields += [T.StructField(name, T.ShortType()), T.StructField(name + RAW_SUFFIX, T.StringType())]
        else:
            fields.append(T.StructField(name, _TYPES[kind]))
    return T.StructType(fields)


def code_of(dictionary: str, code: str) -> int:
    codes = DICTIONARIES[dictionary].split()
    return codes.index(code) + 1 if code in codes else 0
