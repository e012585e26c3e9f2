"""Row types, as DDL."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
TOKEN = f"struct<text:string,normalized_text:string,confidence:double,bbox:{BOX},line_id:string,block_id:string>"
LINE = f"struct<id:string,text:string,normalized_text:string,confidence:double,bbox:{BOX},tokens:array<{TOKEN}>>"
PAGE = f"struct<page_number:int,width:double,height:double,lines:array<{LINE}>,tokens:array<{TOKEN}>>"
DOCUMENT = f"document_id string, source_path string, provider_name string, pages array<{PAGE}>, metadata map<string,string>"
REGION = f"text string, confidence double, bbox {BOX}, page_number int"
SPATIAL = "struct<coordinate_space:string,cluster_id:int,layout_zone:string,attributes:map<string,string>>"
FIELD = (
    "pair_id string, ord long, field_id string, field_type string, label string, value string, raw_text string, "
    f"normalized_label string, normalized_value string, page_number int, bbox {BOX}, confidence double, extraction_rule string, spatial {SPATIAL}"
)
MATCH_TYPES = ("exact_match", "partial_match", "changed_value", "missing_in_target", "extra_in_target", "uncertain")
GOLD_LABELS = ("matched", "changed", "missing", "extra")
BUCKETS = (*GOLD_LABELS, "uncertain", "none")
MANIFEST = "pair_id string, drawing_a_ref string, drawing_b_ref string, annotation_path string, notes string"
ANNOTATION = (
    "schema_version int, pair_id string, fields array<struct<field_id:string,expected:string,optional_notes:string>>, "
    "review_note string, pair_level_expected string, metadata map<string,string>"
)
