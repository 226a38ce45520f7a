"""Schemas of the tables that the stages hand on.  ``ord`` carries the order in which things were found."""

from __future__ import annotations

FILES = "repository_id string, path string, absolute_path string, extension string, language string, size bigint, last_modified timestamp, ord bigint"
SOURCES = f"{FILES}, content string"

PARAMETERS = "array<struct<name:string,type:string>>"
BINDINGS = "array<struct<imported:string,local:string>>"
LOCATION = "start_line int, end_line int, start_offset int, end_offset int"

AST_RECORDS = (
    "repository_id string, file_id string, path string, language string, category string, name string, kind string, module string, "
    f"bindings {BINDINGS}, extends string, implements array<string>, modifiers array<string>, parameters {PARAMETERS}, return_type string, "
    "visibility string, is_async boolean, is_generator boolean, is_static boolean, exported boolean, callee string, arg_count int, is_optional boolean, "
    f"{LOCATION}, start_utf16 int, end_utf16 int, source string, ord bigint"
)

SYMBOLS = (
    "repository_id string, id string, name string, kind string, qualified_name string, parent string, file_id string, exported boolean, "
    f"{LOCATION}, path string, language string, modifiers array<string>, parameters {PARAMETERS}, return_type string, ord bigint"
)

RELATIONS = "repository_id string, source string, target string, relation string, metadata_json string, ord bigint"
NODES = "repository_id string, id string, type string, name string, qualified_name string, file_id string, exported boolean, path string, language string, ord bigint"
EDGES = "repository_id string, src string, dst string, relation string, metadata_json string, ord bigint"

CHUNK_METADATA = (
    "struct<repository_id:string,file_id:string,file_path:string,language:string,symbol_id:string,symbol_type:string,symbol_name:string,"
    "parent_symbol:string,exported:boolean,visibility:string,start_line:int,end_line:int,imports:array<string>,calls:array<string>,"
    "called_by:array<string>,inherits:array<string>,implements:array<string>,children:array<string>,content_hash:string>"
)
CHUNKS = (
    "id string, chunk_type string, symbol_id string, symbol_type string, symbol_name string, parent_symbol string, content string, "
    f"metadata {CHUNK_METADATA}, embedding array<float>, embedding_version int"
)
JOBS = "user_id string, repository_id bigint, installation_id string, clone_url string"
STATUS_LOG = "user_id string, repository_id bigint, status string, progress int, started_at timestamp, completed_at timestamp, last_error string"
ANSWER = (
    "answer string, confidence double, sources array<struct<chunkId:string,filePath:string,symbolName:string,startLine:int,endLine:int>>, followup_questions array<string>"
)
