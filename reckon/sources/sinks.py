"""What a result is written to: a summary line, JSON, CSV exports, one self-contained HTML page."""

from __future__ import annotations

import base64
import csv
import gzip
import html
import json
import os
import tempfile
import uuid
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.diff import Result
from ..plans.options import DiffError


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a private one only where all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise DiffError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="reckon-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def summary_line(result: Result, seconds: float) -> str:
    c = result.counts
    word = "identical" if result.identical else "different"
    return f"{word}: {c['matched']:,} matched, {c['changed']:,} changed, {c['added']:,} added, {c['removed']:,} removed; duplicate keys {c['a_dup_keys']:,} / {c['b_dup_keys']:,}; {seconds:.2f} s"


def _file(path) -> dict:
    if not isinstance(path, str):
        return {"name": "DataFrame", "path": None, "size": None}
    return {"name": os.path.basename(path.rstrip("/")), "path": path, "size": os.path.getsize(path) if os.path.isfile(path) else None}


def meta(result: Result, a, b, seconds: float) -> dict:
    res = result.resolved
    return {
        "key": list(res.key), "compared": list(res.compared), "only_in_a": list(res.only_in_a), "only_in_b": list(res.only_in_b),
        "a_cols": len(result.a_names), "b_cols": len(result.b_names), "a": _file(a), "b": _file(b), "engine": result.options.strategy,
        "seconds": round(seconds, 3), "generated": datetime.now().astimezone().isoformat(timespec="seconds"), "options": asdict(result.options),
    }


def to_json(result: Result, a, b, seconds: float) -> dict:
    return {"meta": meta(result, a, b, seconds), "counts": result.counts, "columns": result.column_stats}


def _write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, absent cells empty; rows stream to the driver, partition by partition."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if x is None else x for x in row])


def export(result: Result, folder: str, single_file: bool = True) -> list[str]:
    """added, removed and changed in full: CSV files, or folders of part files written by the executors."""
    parts = {"added": result.added(False), "removed": result.removed(False), "changed": result.changed_wide(False)}
    if single_file:
        os.makedirs(folder, exist_ok=True)
    for name, df in parts.items():
        if single_file:
            _write_csv(df, f"{folder}/{name}.csv")
        else:
            df.write.csv(f"{folder}/{name}.csv", header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return [f"{folder}/{n}.csv" for n in parts]


def sections(result: Result) -> dict:
    """The capped sections as plain lists, for the page."""
    cut = result.truncated()
    one = lambda df: {"cols": df.columns, "rows": [list(r) for r in df.collect()]}
    changed = [[*list(r)[:-1], [list(d) for d in r["diffs"]]] for r in result.changed().collect()]
    out = {"changed": {"cols": list(result.resolved.key), "rows": changed}, "added": one(result.added()), "removed": one(result.removed()), "dup_a": one(result.duplicates("a")), "dup_b": one(result.duplicates("b"))}
    return {k: v | {"truncated": cut[k]} for k, v in out.items()}


_PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title><style>
:root{color-scheme:light dark;--same:#5b8c5a;--diff:#d08c2c;--gone:#b5524a;--new:#3f77b0}
body{font:14px/1.5 system-ui,sans-serif;margin:0 auto;max-width:1200px;padding:1.5rem}
.share{display:grid;grid-auto-flow:column;gap:2px;margin:1.2rem 0}.share b{height:.9rem}
nav button,.pick{all:unset;cursor:pointer;padding:.1rem .6rem;border-bottom:3px solid #8884}
.on{background:#8883!important;font-weight:600}table{border-collapse:collapse;width:100%;margin-top:.6rem}
th,td{border-bottom:1px solid #8884;text-align:left;padding:.25rem .5rem;vertical-align:top;word-break:break-word}th{cursor:pointer}
input{font:inherit;padding:.2rem .5rem;min-width:16rem}del{color:var(--gone)}ins{color:var(--new);text-decoration:none}
aside{position:fixed;right:0;top:0;bottom:0;width:min(420px,90vw);background:Canvas;border-left:1px solid #8886;padding:1rem;overflow:auto}.none{opacity:.5;font-style:italic}
</style></head><body><h1>@TITLE@</h1><p id="sum"></p><div class="share" id="bar"></div><nav id="tabs"></nav>
<p><input id="q" placeholder="filter rows"> <button class="pick" id="dl">download CSV</button> <span id="chips"></span></p><div id="view"></div>
<aside id="side" hidden></aside><script type="@TYPE@" id="data">@DATA@</script><script>
const $=i=>document.getElementById(i);
async function load(){const t=$("data").textContent;if($("data").type!=="text/gzip-base64")return JSON.parse(t);
 const raw=Uint8Array.from(atob(t),c=>c.charCodeAt(0));return JSON.parse(await new Response(new Blob([raw]).stream().pipeThrough(new DecompressionStream("gzip"))).text())}
load().then(D=>{const names=D.meta.compared;let tab="changed",col=null,by=null,up=1,page=0;const PER=500;
 const c=D.counts;$("sum").textContent=Object.entries(c).map(([k,v])=>k+" "+v.toLocaleString()).join(" \\u00b7 ");
 for(const[k,n,v]of[["unchanged",c.unchanged,"same"],["changed",c.changed,"diff"],["removed",c.removed,"gone"],["added",c.added,"new"]]){if(!n)continue;const i=document.createElement("b");i.style.background="var(--"+v+")";i.title=k+" "+n;$("bar").append(i);$("bar").style.gridTemplateColumns=($("bar").style.gridTemplateColumns+" minmax(2px,"+n+"fr)").trim()}
 const cell=x=>{const s=document.createElement("span");if(x===null){s.className="none";s.textContent="absent"}else s.textContent=x;return s};
 const diffs=(box,ds)=>ds.forEach(([i,a,b])=>{const d=document.createElement("div"),o=document.createElement("del"),n=document.createElement("ins");o.append(cell(a));n.append(cell(b));d.append(names[i]+": ",o," \\u2192 ",n);box.append(d)});
 const rows=()=>{let r=D.sections[tab].rows,q=$("q").value.toLowerCase();if(q)r=r.filter(x=>JSON.stringify(x).toLowerCase().includes(q));
  if(tab==="changed"&&col!==null)r=r.filter(x=>x[x.length-1].some(d=>d[0]===col));if(by!==null)r=[...r].sort((a,b)=>String(a[by]??"").localeCompare(String(b[by]??""),undefined,{numeric:true})*up);return r};
 const cols=()=>[...D.sections[tab].cols,...(tab==="changed"?["differences"]:[])];
 function show(){$("tabs").replaceChildren(...Object.keys(D.sections).map(k=>{const b=document.createElement("button");b.textContent=k+" "+D.sections[k].rows.length+(D.sections[k].truncated?"+":"");b.className=k===tab?"on":"";b.onclick=()=>{tab=k;by=null;page=0;show()};return b}));
  $("chips").replaceChildren(...(tab==="changed"?D.columns.map((s,i)=>[s,i]).filter(([s])=>s.changed).map(([s,i])=>{const b=document.createElement("button");b.className="pick"+(col===i?" on":"");b.textContent=s.column+" "+s.changed;b.onclick=()=>{col=col===i?null:i;show()};return b}):[]));
  const t=document.createElement("table"),h=t.insertRow();cols().forEach((n,i)=>{const x=document.createElement("th");x.textContent=n;x.onclick=()=>{up=by===i?-up:1;by=i;show()};h.append(x)});
  const all=rows(),pages=Math.max(1,Math.ceil(all.length/PER));page=Math.min(page,pages-1);
  all.slice(page*PER,page*PER+PER).forEach(r=>{const w=t.insertRow();r.forEach((x,i)=>{const d=w.insertCell();if(Array.isArray(x))diffs(d,x);else d.append(cell(x))});
   w.onclick=()=>{const s=$("side");s.hidden=false;s.replaceChildren();const b=document.createElement("button");b.textContent="close";b.onclick=()=>{s.hidden=true};s.append(b);r.forEach((x,i)=>{const p=document.createElement("p");p.append(cols()[i]+": ");Array.isArray(x)?diffs(p,x):p.append(cell(x));s.append(p)})}});
  const nav=document.createElement("p"),step=(s,d)=>{const b=document.createElement("button");b.textContent=s;b.disabled=page+d<0||page+d>=pages;b.onclick=()=>{page+=d;show()};nav.append(b)};
  step("earlier",-1);nav.append(" rows "+(all.length?page*PER+1:0)+" to "+Math.min(all.length,page*PER+PER)+" of "+all.length+" ");step("later",1);
  $("view").replaceChildren(nav,t)}
 $("q").oninput=()=>{page=0;show()};$("dl").onclick=()=>{const e=x=>'"'+String(x===null?"":Array.isArray(x)?x.map(([i,a,b])=>names[i]+": "+a+" -> "+b).join("; "):x).replaceAll('"','""')+'"';
  const a=document.createElement("a");a.href=URL.createObjectURL(new Blob([[cols(),...rows()].map(r=>r.map(e).join(",")).join("\\n")]));a.download=tab+".csv";a.click()};show()});
</script></body></html>
"""


def render_html(result: Result, a, b, seconds: float, compress: bool = True) -> str:
    data = json.dumps(to_json(result, a, b, seconds) | {"sections": sections(result)}, ensure_ascii=False, separators=(",", ":"))
    title = html.escape(f"{_file(a)['name']} vs {_file(b)['name']}")
    if compress:
        kind, body = "text/gzip-base64", base64.b64encode(gzip.compress(data.encode(), mtime=0)).decode()
    else:
        kind, body = "application/json", data.replace("</", "<\\/")
    return _PAGE.replace("@TITLE@", title).replace("@TYPE@", kind).replace("@DATA@", body)
