"""Explicit schemas of the document and call tables."""

from __future__ import annotations

# Evidence reference: a block, table or figure.
REF = "struct<kind:string,id:string>"

BLOCK = (
    "struct<id:string,page:int,type:string,text_raw:string,bbox:array<double>,parser_order:int,reading_order:int,"
    "section_id:string,source_type:string,source_content_index:int,source_field:string,text_level:int,"
    "line_start:int,line_end:int,table_id:string,figure_id:string>"
)
SECTION = (
    "struct<id:string,level:int,title_block_id:string,parent_id:string,child_section_ids:array<string>,"
    "content_block_ids:array<string>>"
)
TABLE = (
    "struct<id:string,section_id:string,title_block_id:string,caption_block_ids:array<string>,"
    "footnote_block_ids:array<string>,continuation_block_ids:array<string>,source_content_index:int,status:string,"
    "format:string,columns:array<string>,rows:array<array<string>>,content:string,"
    "fragments:array<struct<page:int,bbox:array<double>,crop_path:string>>>"
)
FIGURE = (
    "struct<id:string,page:int,section_id:string,bbox:array<double>,caption_block_id:string,"
    "caption_block_ids:array<string>,footnote_block_ids:array<string>,asset_path:string,source_content_index:int>"
)
PAGE = "struct<page:int,width:double,height:double,block_ids:array<string>>"
BUNDLE = (
    "document struct<id:string,title:string,page_count:int,source_sha256:string,source_file:string,source_format:string>, "
    f"pages array<{PAGE}>, blocks array<{BLOCK}>, reading_order array<string>, sections array<{SECTION}>, "
    f"tables array<{TABLE}>, figures array<{FIGURE}>, _corrupt_record string"
)
CONTENT_ITEM = (
    "array<struct<page_idx:int,type:string,text:string,text_level:int,bbox:array<double>,table_body:string,"
    "table_caption:array<string>,table_footnote:array<string>,image_caption:array<string>,"
    "image_footnote:array<string>,chart_caption:array<string>,chart_footnote:array<string>>>"
)
