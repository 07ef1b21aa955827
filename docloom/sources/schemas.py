"""Schemas of the engine's relations."""

ROWS = "array<struct<row_type:string,cells:array<struct<value:string,colspan:int,rowspan:int>>>>"
BLOCK = f"block_id string, type string, page int, page_end int, content string, heading_level int, section_path string, caption string, col_count int, rows {ROWS}, image_ref string, ocr_text string, ocr_status string"
PASSPORT = "doc_id string, source_filename string, doc_type string, title string, summary string, key_topics array<string>, sections array<struct<section_id:string,title:string,summary:string,key_entities:array<string>>>"
MANIFEST = "tender_id string, status string, source_url string, total_size_bytes long, documents array<struct<doc_id:string,filename:string,archive_path:string,size_bytes:long,ext:string>>"
DOCUMENT = f"doc_id string, source_filename string, source_format string, total_pages int, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
INDEX = "tenders map<string,struct<status:string,downloaded_at:string,document_count:int>>"
MAP = "tender_id string, passports array<struct<doc_id:string,doc_type:string,title:string,summary:string>>"
#: Ordered states of a collection.
STATUSES = "created downloaded extracted parsed ocr_done passports_done indexed failed".split()
OCR_STATUSES = "pending completed skipped failed".split()
ROW_TYPES = "header section data subtotal".split()
