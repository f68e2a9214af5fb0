"""Explicit schemas of the nested documents; readers never infer."""

ADVISORY = """
id string, aliases array<string>, summary string,
severity array<struct<type:string,score:string>>,
affected array<struct<package:struct<name:string,ecosystem:string>,
  ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>>>
"""

ADVISORY_FACTS = """
ghsa_id string, severity string, cvss struct<score:double>, epss struct<percentile:double>,
cwes array<struct<cwe_id:string>>
"""

NPM_LOCK = """
lockfileVersion int,
packages map<string,struct<version:string,link:boolean,dev:boolean,resolved:string,name:string,dependencies:map<string,string>>>,
dependencies map<string,struct<version:string>>
"""

PIPFILE_LOCK = "`default` map<string,struct<version:string>>, develop map<string,struct<version:string>>"

MANIFEST = """
name string, dependencies map<string,string>, devDependencies map<string,string>,
engines struct<node:string>, overrides map<string,string>
"""

PACKUMENT = "name string, `dist-tags` struct<latest:string>, versions map<string,string>"

PYPI_DOCUMENT = "info struct<name:string,version:string>, releases map<string,string>"
SPEC = "openapi string, swagger string, basePath string, servers array<struct<url:string>>, paths map<string,map<string,string>>"

MANIFEST_OF_SPECS = "apis array<struct<name:string,properties:array<struct<type:string,url:string>>>>"

HADOLINT = "array<struct<file:string,line:int,column:int,code:string,level:string,message:string>>"
SHELLCHECK = "array<struct<file:string,line:int,column:int,code:int,level:string,message:string>>"

BENCHMARK_CASE = "id string, pkg string, toVersion string, minimalEdits int"

WEBHOOK = """
event string, delivery bigint, received_at timestamp, action string,
installation struct<id:bigint,account:string>,
repositories array<struct<full_name:string,default_branch:string>>,
repositories_added array<struct<full_name:string,default_branch:string>>,
repositories_removed array<struct<full_name:string,default_branch:string>>,
repository struct<full_name:string,default_branch:string>,
ref string,
check_suite struct<status:string,conclusion:string,head_branch:string,head_sha:string>,
pull_request struct<number:bigint,branch:string,url:string>
"""

SCAN_FEED = "repo string, scan string, finding string"
