"""Schemas of the index tables."""

from __future__ import annotations

ANNOTATIONS = "array<struct<type_sig:string,values:map<string,string>>>"
TYPE_PARAMS = "array<struct<name:string,bounds:array<string>>>"
FIELD = f"struct<modifiers:int,name:string,sig:string,const:struct<tag:string,i:bigint,d:double,s:string>,annotations:{ANNOTATIONS}>"
PARAMETER = f"struct<name:string,modifiers:int,sig:string,annotations:{ANNOTATIONS}>"
METHOD = f"struct<modifiers:int,name:string,return_sig:string,params:array<{PARAMETER}>,throws:array<string>,type_params:{TYPE_PARAMS},varargs:boolean,has_body:boolean,annotation_default:string,annotations:{ANNOTATIONS}>"
HINTS = "struct<source_package:string,single_imports:map<string,string>,on_demand:array<string>,siblings:array<string>>"

#: One row per type declaration.
TYPE_COLUMNS = [
    ("jvm_name", "string"), ("modifiers", "int"), ("decl_kind", "string"), ("super_sig", "string"), ("interface_sigs", "array<string>"), ("type_params", TYPE_PARAMS),
    ("fields", f"array<{FIELD}>"), ("methods", f"array<{METHOD}>"), ("inner_types", "array<string>"), ("permitted", "array<string>"),
    ("record_components", f"array<struct<name:string,sig:string,annotations:{ANNOTATIONS}>>"), ("annotations", ANNOTATIONS), ("hints", HINTS),
]
EXPORT = "struct<package:string,flags:int,to:array<string>>"
MODULE_COLUMNS = [
    ("name", "string"), ("version", "string"), ("flags", "int"), ("requires", "array<struct<module:string,flags:int,version:string>>"), ("exports", f"array<{EXPORT}>"), ("opens", f"array<{EXPORT}>"),
    ("uses", "array<string>"), ("provides", "array<struct<service:string,impls:array<string>>>"), ("packages", "array<string>"), ("main_class", "string"),
]
TYPE_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in TYPE_COLUMNS) + ">"
MODULE_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in MODULE_COLUMNS) + ">"
#: What a parser makes of one file: types, modules, identifiers, and an error instead of them.
PARSED = f"source_uri string, resource_path string, origin string, size long, types array<{TYPE_STRUCT}>, modules array<{MODULE_STRUCT}>, names array<string>, error string"
RESOURCE = "source_uri string, resource_path string, content binary, error string"
OCCURRENCE = "struct<name:string,start_off:int,end_off:int,line:int,col:int,is_declaration:boolean,role:string,scope:string,owner:string,receiver:string,params:array<string>,arity:int>"
OCCURRENCES = f"source_uri string, resource_path string, source_package string, siblings array<string>, single_imports map<string,string>, on_demand array<string>, found array<{OCCURRENCE}>"
MANIFEST_TARGET = "struct<compilerOptions:array<string>,javaHome:string,sources:array<string>,classes:array<string>,dependencyModules:array<string>,dependsOn:array<string>>"
MANIFEST = f"namespaces map<string,{MANIFEST_TARGET}>, dependencyModules array<struct<id:string,jar:string,sources:string>>"
