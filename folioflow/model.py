"""Canonical schemas of the document model; every level carries an explicit ordinal because DataFrames have no order."""

from __future__ import annotations

from pyspark.sql import types as T

#: Item types of the model (fixed values).
ITEM_TYPES = [
    "hero", "part_title", "section_heading", "paragraph", "note", "side_note", "figure", "scene",
    "interactive_callout", "nav_anchor", "clear", "table", "list", "equation", "dialogue",
]
#: Types that show in navigation unless told otherwise (fixed values).
NAV_DEFAULT_TYPES = ["part_title", "section_heading", "scene", "nav_anchor", "dialogue"]
#: Types whose body is rich text that callouts may quote (fixed values).
CALLOUT_TEXT_TYPES = ["paragraph", "note", "side_note", "list", "equation"]
LAB_STATUSES = ["ready", "planned", "archived"]

NODE = "struct<type:string,text:string,bold:boolean,italic:boolean,underline:boolean,superscript:boolean,subscript:boolean,color:string,highlight:string,source:string,mathml:string,href:string,target:string,children:array<struct<type:string,text:string>>>"
VISIBILITY = "struct<screenOnly:boolean,printOnly:boolean,screen:boolean,print:boolean>"
STEP = "struct<title:string,preset:string,printPreset:string,state:map<string,string>,printQuery:map<string,string>,observeItems:array<string>>"
ITEM = (
    "struct<id:string,type:string,title:string,label:string,caption:string,src:string,alt:string,level:int,"
    f"nav:struct<show:boolean,label:string>,visibility:{VISIBILITY},layout:struct<placement:string,widthPx:double,heightPx:double,aspectRatio:string,wrap:boolean,floatInteraction:string>,"
    f"body:struct<format:string,nodes:array<{NODE}>>,sequenceSteps:array<{STEP}>,sequenceSceneId:string,print:struct<expand:string>>"
)
PAGE = f"struct<id:string,sourcePage:string,visibility:{VISIBILITY},items:array<{ITEM}>>"
BOOK = (
    "struct<schemaVersion:string,meta:struct<title:string,subtitle:string,authoringVersion:string,updatedAt:string,"
    "library:struct<discipline:string,level:string,category:string,status:string,tags:array<string>>>,"
    f"pages:array<{PAGE}>>"
)
LABS = (
    "struct<labs:array<struct<id:string,title:string,discipline:string,baseUrl:string,defaultQuery:map<string,string>,parameterMap:map<string,string>,"
    "presets:array<struct<id:string,title:string,status:string,description:string,query:map<string,string>,url:string>>>>>"
)


def struct(ddl: str) -> T.StructType:
    """A StructType out of the DDL of a struct<...>."""
    return T.StructType.fromDDL("x " + ddl)["x"].dataType
