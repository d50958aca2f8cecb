"""Record types, as Spark DDL. Ordinals are columns because order matters to the operators."""

BBOX = "struct<x:double,y:double,width:double,height:double>"
LINE = f"struct<text:string,bbox:{BBOX}>"
TEXT_ITEMS = f"doc_id bigint, page_number int, item_ord int, text string, bbox {BBOX}"
LINES = f"doc_id bigint, page_number int, line_ord int, text string, bbox {BBOX}"
CHUNKS = (
    f"doc_id bigint, page_number int, chunk_ord int, id string, text string, snippet string, bbox {BBOX}, block_count int, line_count int, "
    f"lines array<{LINE}>, is_fallback boolean, element_type string, heading_level int"
)
MESSAGES = "conv_id bigint, turn int, role string, text string"
TENSORS = "name string, file_path string, dtype string, shape array<bigint>, element_count bigint, byte_start bigint, byte_end bigint, byte_length bigint"
WORKER_EVENTS = "request_id bigint, seq bigint, type string, payload string"

EMBEDDING_DIMS, LAYOUT_DIMS = 384, 16
TEXT_DIMS = EMBEDDING_DIMS - LAYOUT_DIMS
PAGE_LINES, PAGE_WIDTH, PAGE_HEIGHT = 40, 612.0, 792.0
CHUNK_CHARS, CHUNK_GAP = 620, 0.08
