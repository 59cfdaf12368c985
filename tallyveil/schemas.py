"""Schemas of report batches, domains, results and budget units."""

from __future__ import annotations

REPORT = "payload binary, key_id string, shared_info string"
DOMAIN = "bucket binary"
SUMMARY = "bucket binary, metric bigint"
DEBUG = "bucket binary, unnoised_metric bigint, noise bigint, annotations array<string>"
LEDGER = "privacy_budget_key string, reporting_window timestamp, reporting_origin string, used int"
FACTS = "array<struct<bucket:binary,value:bigint,id:decimal(20,0)>>"
PAYLOAD = f"struct<operation:string,data:{FACTS}>"
#: Times arrive as numbers or text; as text, fractions and large values survive.
SHARED_INFO_JSON = (
    "version string, api string, scheduled_report_time string, reporting_origin string, attribution_destination string, source_registration_time string, report_id string, debug_mode string"
)
UNIT = ["privacy_budget_key", "reporting_window", "reporting_origin"]
