from pyspark.sql import functions as F

from quillscope.sources import source_code as sc

GO = '''package main

import (
	"fmt"
	x "os"
)

//go:embed data
var data, more string

const limit = 5

// Shape is a thing.
type Shape interface {
	Area() float64
	Scale(by float64) (out Shape, err error)
}

type Box struct {
	W, H float64
	tags map[string][]int `json:"t"`
}

func (b *Box) Area() float64 { return b.W * b.H }

func main() {
	n := 0
	for i := 0; i < 3; i++ {
		n += i
		if n > 2 {
			fmt.Println("x{")
		} else if n == 1 {
			return
		} else {
			go run(n)
		}
	}
	switch n {
	case 1:
		n = 4
	default:
		n--
	}
	ch <- n
	defer x.Exit(0)
}
'''

JS = '''import { readable as r, writable } from "svelte/store";
import "side-effects";
// a comment here
export interface Props { name: string }
export type Id = string;
enum Kind { A }
export class Base extends Other {
  private static count: number = 0;
  name?: string;
  constructor(a) {
    if (a) { }
  }
  get size() { return 1; }
  async load(url) {
    const local = 5;
  }
}
export async function start(x) {}
const go = async (x) => x;
let other = y => y;
export const LIMIT = 5;
<Header title="a title" />
'''


def count(elements, tag):
    return [v for t, v in elements if t == tag]


def test_go():
    e = sc.go_elements(GO)
    assert e[0] == ("directive", "data\0//go:embed data") and e[1] == ("package", "main") and count(e, "import") == ['"fmt"', '"os"']
    assert count(e, "type") == ["Shape", "Box"] and count(e, "interface") == ["Shape"] and count(e, "struct") == ["Box"]
    assert count(e, "field") == ["Box\0W float64", "Box\0H float64", "Box\0tags map[string][]int"]
    assert count(e, "method") == ["Area() float64", "Scale(by float64) (out Shape, err error)", "b\0*Box.Area() float64"] and count(e, "ident:receiver") == ["b"]
    assert count(e, "func") == ["main()"] and count(e, "ident:var-name") == ["data string", "more string", "limit"]
    tags = [t for t, v in e if v.startswith("main\0") and t not in ("func",)]
    assert tags == ["assign", "for", "assign", "if", "expr", "if", "return", "go", "switch", "case", "case", "send", "defer"]
    line = GO[: GO.index("n := 0")].count("\n") + 1
    assert ("assign", f"main\0{line}\0n := 0") in e
    assert sc.go_elements("package p\nfunc (") == [] and sc.looks_like_go(GO) and not sc.looks_like_go("hello")


def test_js():
    e = sc.js_elements(JS)
    assert count(e, "import") == ["svelte/store", "side-effects"] and count(e, "comment") == ["a comment here"]
    assert count(e, "type") == ["Props", "Id", "Kind", "Base"] and count(e, "struct") == [""] and count(e, "interface") == [""]
    assert count(e, "field") == ["count", "name"] and count(e, "method") == ["size", "load"]
    assert count(e, "func") == ["start", "go", "other"] and count(e, "ident") == ["r", "writable", "LIMIT", "Header"] and count(e, "literal") == ['"a title"']
    assert sc.looks_like_js(JS) and not sc.looks_like_js("plain")


def test_table(spark):
    df = spark.createDataFrame([("a.go", GO), ("b.go", None), ("c.go", "")], "p string, t string")
    got = sc.source_elements(df, F.col("p"), F.col("t"), "go")
    assert got.where("path = 'a.go'").count() == len(sc.go_elements(GO)) and got.where("path <> 'a.go'").count() == 0
    assert sc.script_elements(spark.createDataFrame([("x", JS), ("y", "no code")], "p string, t string"), F.col("p"), F.col("t")).select("path").distinct().count() == 1
