"""Small files of every language and what they must give; the queries over them are held against these rows.

Rows were written by hand from the rules, not taken from a run, but for the line numbers of ``SOURCES``, which were filled
in from one and read over against the sources. A first run showed two slips in rows written by hand (the line of the last
link in ``LINKS``, a blank line in ``CONTENTS``), which were mended here by the rules.
"""

from __future__ import annotations

#: By language: a source, and its chunks (key, variant, heading, text below the heading, line).
SOURCES: dict[str, tuple[str, list[tuple[str, str, str, str, int]]]] = {
    'go': (
        """// Package brew brews tea.
package brew

import "time"

// Limit is the hottest a cup may be.
const Limit = 90

var hidden = 2

// Pourer is met by kettles.
type Pourer interface {
	Pour() bool
}

// holds at compile time.
var _ Pourer = (*Kettle)(nil)

// Kettle holds water.
type Kettle struct {
	litres int
}

// NewKettle makes one.
func NewKettle(litres int) *Kettle { return &Kettle{litres: litres} }

// Pour empties the kettle.
func (k *Kettle) Pour() bool { return true }

// Get reads a cup.
func (c *Shelf[K, V]) Get(k K) (V, bool) { var v V; return v, false }

// Cups and pots.
type (
	Cup struct{ W, H int }
	Pot  struct{ A Cup }
)

//go:generate tool -type=Leaf
// Leaf lists leaves.
type Leaf int

//nolint:gochecknoglobals
var registry = map[string]Leaf{}

// A remark on its own.

func Alone() interface{ Do() } { return nil }
""",
        [
            ('go/package', 'package', 'package brew', 'Package brew brews tea.', 2),
            ('go/const/Limit', 'value', 'brew > Limit', 'const Limit = 90\n\nLimit is the hottest a cup may be.', 7),
            ('go/type/Pourer', 'type', 'brew > Pourer', 'type Pourer interface {\n\tPour() bool\n}\n\nPourer is met by kettles.', 12),
            ('go/type/Kettle', 'type', 'brew > Kettle', 'type Kettle struct {\n\tlitres int\n}\n\nKettle holds water.', 20),
            ('go/func/NewKettle', 'func', 'brew > NewKettle', 'func NewKettle(litres int) *Kettle\n\nNewKettle makes one.', 25),
            ('go/method/Kettle.Pour', 'method', 'brew > Kettle.Pour', 'func (k *Kettle) Pour() bool\n\nPour empties the kettle.', 28),
            ('go/method/Shelf.Get', 'method', 'brew > Shelf.Get', 'func (c *Shelf[K, V]) Get(k K) (V, bool)\n\nGet reads a cup.', 31),
            ('go/type/Cup', 'type', 'brew > Cup', 'type Cup struct{ W, H int }\n\nCups and pots.', 35),
            ('go/type/Pot', 'type', 'brew > Pot', 'type Pot struct{ A Cup }\n\nCups and pots.', 36),
            ('go/type/Leaf', 'type', 'brew > Leaf', 'type Leaf int\n\nLeaf lists leaves.', 41),
            ('go/func/Alone', 'func', 'brew > Alone', 'func Alone() interface{ Do() }', 48),
        ],
    ),
    'typescript': (
        """/** Limit is the hottest a cup may be. */
export const Limit = 90;

const hidden = 2;

/** Pourer is met by kettles. */
export interface Pourer {
  pour(): boolean;
  readonly litres: number;
}

/** Id names a cup. */
export type Id = string | number;

/** Tint lists tints. */
export enum Tint { Red, Green }

/** Kettle holds water. */
export class Kettle extends Base implements Pourer {
  private litres: number;
  /** Builds a Kettle. */
  constructor(litres: number) { this.litres = litres; }
  /** heat warms it. */
  async heat(to: Range): Promise<void> { return; }
  get size(): number { return 1; }
  set size(v: number) {}
  /** onBoil is bound. */
  onBoil = (n: number): void => {};
}

/** sip is free. */
export function sip(): boolean { return true; }

/** twice doubles. */
export const twice = (x: number): number => x * 2;

/** Outer groups. */
export namespace Outer {
  /** inner lies within. */
  export function inner(): void {}
}

/** Gadget has a decorator. */
@Part({ name: "gadget" })
class Gadget {
  /** fetch loads. */
  @action
  fetch(id: string): Promise<void> { return; }
}
""",
        [
            ('ts/const/Limit', 'value', 'Limit', 'const Limit = 90\n\nLimit is the hottest a cup may be.', 2),
            ('ts/interface/Pourer', 'interface', 'Pourer', 'interface Pourer {\n  pour(): boolean;\n  readonly litres: number;\n}\n\nPourer is met by kettles.', 7),
            ('ts/type/Id', 'type', 'Id', 'type Id = string | number\n\nId names a cup.', 13),
            ('ts/enum/Tint', 'enum', 'Tint', 'enum Tint { Red, Green }\n\nTint lists tints.', 16),
            ('ts/class/Kettle', 'class', 'Kettle', 'class Kettle extends Base implements Pourer\n\nKettle holds water.', 19),
            ('ts/method/Kettle.constructor', 'method', 'Kettle.constructor', 'constructor(litres: number)\n\nBuilds a Kettle.', 22),
            ('ts/method/Kettle.heat', 'method', 'Kettle.heat', 'async heat(to: Range): Promise<void>\n\nheat warms it.', 24),
            ('ts/method/Kettle.size', 'method', 'Kettle.size', 'get size(): number', 25),
            ('ts/method/Kettle.size#2', 'method', 'Kettle.size', 'set size(v: number)', 26),
            ('ts/method/Kettle.onBoil', 'method', 'Kettle.onBoil', 'onBoil = (n: number): void =>\n\nonBoil is bound.', 28),
            ('ts/func/sip', 'func', 'sip', 'function sip(): boolean\n\nsip is free.', 32),
            ('ts/func/twice', 'func', 'twice', 'const twice = (x: number): number =>\n\ntwice doubles.', 35),
            ('ts/func/Outer.inner', 'func', 'Outer.inner', 'function inner(): void\n\ninner lies within.', 40),
            ('ts/class/Gadget', 'class', 'Gadget', 'class Gadget\n\nGadget has a decorator.', 45),
            ('ts/method/Gadget.fetch', 'method', 'Gadget.fetch', 'fetch(id: string): Promise<void>\n\nfetch loads.', 48),
        ],
    ),
    'javascript': (
        """/** add sums. */
exports.add = function(a, b) { return a + b; };
module.exports.mul = (a, b) => a * b;
/** VERSION tells. */
exports.VERSION = "1.2";
exports.silent = 42;""",
        [
            ('ts/func/add', 'func', 'add', 'exports.add = function(a, b)\n\nadd sums.', 2),
            ('ts/func/mul', 'func', 'mul', 'module.exports.mul = (a, b) =>', 3),
            ('ts/value/VERSION', 'value', 'VERSION', 'exports.VERSION = "1.2"\n\nVERSION tells.', 5),
        ],
    ),
    'python': (
        """\"\"\"About the module.\"\"\"

LIMIT = 90
\"\"\"The hottest.\"\"\"

_HIDDEN = 1
\"\"\"Not shown.\"\"\"

BARE = 3

# A remark.
class Kettle(Base):
    \"\"\"Holds water.\"\"\"

    def heat(self, to: int) -> bool:
        \"\"\"Warms it.\"\"\"
        return True

@router.post("/cups")
async def brew(a, b=2) -> str:
    \"\"\"Brews a cup.\"\"\"
    return "x"

# Not what counts.
def first():
    \"\"\"What counts.\"\"\"

# All there is.
def second(): pass
""",
        [
            ('py/module', 'package', 'module', 'About the module.', 1),
            ('py/const/LIMIT', 'value', 'LIMIT', 'LIMIT = 90\n\nThe hottest.', 3),
            ('py/class/Kettle', 'class', 'Kettle', 'class Kettle(Base)\n\nHolds water.', 12),
            ('py/method/Kettle.heat', 'method', 'Kettle.heat', 'def heat(self, to: int) -> bool\n\nWarms it.', 15),
            ('py/func/brew', 'func', 'brew', '@router.post("/cups") async def brew(a, b=2) -> str\n\nBrews a cup.', 19),
            ('py/func/first', 'func', 'first', 'def first()\n\nWhat counts.', 25),
            ('py/func/second', 'func', 'second', 'def second()\n\nAll there is.', 29),
        ],
    ),
    'java': (
        """package a.b;
/** Holds water. */
public class Kettle implements Runnable {
  private int litres = size();
  /** Warms it. */
  @Override
  public boolean heat(int to) { return true; }
  public Kettle(int litres) { }
  interface Cup { void fill(); }
}
/** Tints. */
enum Tint { A, B }
record Point(int x) {}
""",
        [
            ('java/class/Kettle', 'class', 'Kettle', 'public class Kettle implements Runnable\n\nHolds water.', 3),
            ('java/method/Kettle.heat', 'method', 'Kettle.heat', '@Override public boolean heat(int to)\n\nWarms it.', 6),
            ('java/method/Kettle.Kettle', 'method', 'Kettle.Kettle', 'public Kettle(int litres)', 8),
            ('java/interface/Kettle.Cup', 'interface', 'Kettle.Cup', 'interface Cup', 9),
            ('java/method/Kettle.Cup.fill', 'method', 'Kettle.Cup.fill', 'void fill();', 9),
            ('java/enum/Tint', 'enum', 'Tint', 'enum Tint { A, B }\n\nTints.', 12),
            ('java/record/Point', 'class', 'Point', 'record Point(int x) {}', 13),
        ],
    ),
    'csharp': (
        """namespace Tea {
/// <summary>Holds water.</summary>
public class Kettle {
  /// <summary>Warms.</summary>
  public bool Heat(int to) { return true; }
  public int Litres { get; set; } = 5;
  int Twice(int x) => 2 * x;
}
public interface ICup { void Fill(); }
public enum Tint { A }
}
""",
        [
            ('cs/namespace/Tea', 'module', 'Tea', 'namespace Tea', 1),
            ('cs/class/Tea.Kettle', 'class', 'Tea.Kettle', 'public class Kettle\n\n/ <summary>Holds water.</summary>', 3),
            ('cs/method/Tea.Kettle.Heat', 'method', 'Tea.Kettle.Heat', 'public bool Heat(int to)\n\n/ <summary>Warms.</summary>', 5),
            ('cs/property/Tea.Kettle.Litres', 'value', 'Tea.Kettle.Litres', 'public int Litres', 6),
            ('cs/method/Tea.Kettle.Twice', 'method', 'Tea.Kettle.Twice', 'int Twice(int x)', 7),
            ('cs/interface/Tea.ICup', 'interface', 'Tea.ICup', 'public interface ICup', 9),
            ('cs/method/Tea.ICup.Fill', 'method', 'Tea.ICup.Fill', 'void Fill();', 9),
            ('cs/enum/Tea.Tint', 'enum', 'Tea.Tint', 'public enum Tint', 10),
        ],
    ),
    'rust': (
        """/// Holds water.
pub struct Kettle { litres: String }
/// Warms it.
pub fn heat(to: u32) -> bool { true }
impl<'a> Pour for Kettle {
    /// Runs.
    pub fn run(&self) {}
}
/// A trait.
pub trait Pour { fn go(&self); }
// Only a note.
pub fn plain() {}
/// Lost behind an attribute.
#[derive(Debug)]
enum Tint { A }
mod inner { pub type Id = u64; }
""",
        [
            ('rs/struct/Kettle', 'struct', 'Kettle', 'pub struct Kettle { litres: String }\n\nHolds water.', 2),
            ('rs/func/heat', 'func', 'heat', 'pub fn heat(to: u32) -> bool\n\nWarms it.', 4),
            ('rs/func/Kettle.run', 'func', 'Kettle.run', 'pub fn run(&self)\n\nRuns.', 7),
            ('rs/trait/Pour', 'trait', 'Pour', 'pub trait Pour\n\nA trait.', 10),
            ('rs/func/Pour.go', 'func', 'Pour.go', 'fn go(&self);', 10),
            ('rs/func/plain', 'func', 'plain', 'pub fn plain()', 12),
            ('rs/enum/Tint', 'enum', 'Tint', 'enum Tint { A }', 15),
            ('rs/mod/inner', 'module', 'inner', 'mod inner', 16),
            ('rs/type/inner.Id', 'type', 'inner.Id', 'pub type Id = u64', 16),
        ],
    ),
    'c': (
        """#include <stdio.h>
// Sips.
int sip(int b) { return b; }
int later(int b);
// A cup.
struct Cup { int w; };
typedef struct { int a; } Pot;
static const int table[] = { 1, 2 };
enum Tint { RED };
struct Cup one = { 1 };
#ifdef DEBUG
int hidden(void) { return 0; }
#endif
char *name(void) { return 0; }
""",
        [
            ('c/func/sip', 'func', 'sip', 'int sip(int b)\n\nSips.', 3),
            ('c/struct/Cup', 'struct', 'Cup', 'struct Cup { int w; }\n\nA cup.', 6),
            ('c/type/Pot', 'type', 'Pot', 'typedef struct { int a; } Pot', 7),
            ('c/enum/Tint', 'enum', 'Tint', 'enum Tint { RED }', 9),
            ('c/func/name', 'func', 'name', 'char *name(void)', 14),
        ],
    ),
    'cpp': (
        """// A kettle.
class Kettle : public Base {
public:
  // Warms it.
  bool heat(int to);
  int litres;
  void pour() const { }
};
// Sips.
int sip(int b) { return b; }
int sip(char b) { return 0; }
struct P { int x; };
namespace tea { bool Kettle::heat(int to) { return true; } }
""",
        [
            ('cpp/class/Kettle', 'class', 'Kettle', 'class Kettle : public Base\n\nA kettle.', 2),
            ('cpp/method/Kettle.heat', 'method', 'Kettle.heat', 'bool heat(int to)\n\nWarms it.', 5),
            ('cpp/func/Kettle.pour', 'func', 'Kettle.pour', 'void pour() const', 7),
            ('cpp/func/sip', 'func', 'sip', 'int sip(int b)\n\nSips.', 10),
            ('cpp/func/sip~1', 'func', 'sip', 'int sip(char b)', 11),
            ('cpp/struct/P', 'struct', 'P', 'struct P { int x; }', 12),
            ('cpp/namespace/tea', 'module', 'tea', 'namespace tea', 13),
            ('cpp/func/tea.Kettle::heat', 'func', 'tea.Kettle::heat', 'bool Kettle::heat(int to)', 13),
        ],
    ),
    'ruby': (
        """# Holds water.
class Kettle < Base
  # Warms it.
  def heat(to)
    if to > 3 then x end
    cups.each do |c|
      c.fill
    end
    true
  end

  def self.make = new
  class << self
    def all; [] end
  end
end
module Empty
end
""",
        [
            ('rb/class/Kettle', 'class', 'Kettle', 'class Kettle < Base\n\nHolds water.', 2),
            ('rb/method/Kettle.heat', 'method', 'Kettle.heat', 'def heat(to)\n\nWarms it.', 4),
            ('rb/method/Kettle.make', 'method', 'Kettle.make', 'def self.make', 12),
            ('rb/class/Kettle.self', 'class', 'Kettle.self', 'class << self', 13),
            ('rb/method/Kettle.self.all', 'method', 'Kettle.self.all', 'def all', 14),
            ('rb/module/Empty', 'module', 'Empty', 'module Empty\nend', 17),
        ],
    ),
    'php': (
        """<?php
namespace Tea;
/** Holds water. */
final class Kettle {
  private $litres = [1];
  /** Warms it. */
  public function heat(int $to): bool { return true; }
}
/** Sips. */
function sip(): string { return "x"; }
""",
        [
            ('php/class/Kettle', 'class', 'Kettle', 'final class Kettle\n\nHolds water.', 4),
            ('php/method/Kettle.heat', 'method', 'Kettle.heat', 'public function heat(int $to): bool\n\nWarms it.', 7),
            ('php/func/sip', 'func', 'sip', 'function sip(): string\n\nSips.', 10),
        ],
    ),
    'scala': (
        """/** Holds water. */
class Kettle(litres: String = "x") {
  val a = 1
  /** Warms it. */
  def heat(to: Int): Boolean = true
}
/** An object. */
object Util { def sip: String = "x" }
trait Pour
type Id = Long
""",
        [
            ('scala/class/Kettle', 'class', 'Kettle', 'class Kettle(litres: String = "x")\n\nHolds water.', 2),
            ('scala/func/Kettle.heat', 'func', 'Kettle.heat', 'def heat(to: Int): Boolean\n\nWarms it.', 5),
            ('scala/object/Util', 'module', 'Util', 'object Util\n\nAn object.', 8),
            ('scala/func/Util.sip', 'func', 'Util.sip', 'def sip: String', 8),
            ('scala/trait/Pour', 'trait', 'Pour', 'trait Pour', 9),
            ('scala/type/Id', 'type', 'Id', 'type Id = Long', 10),
        ],
    ),
    'lua': (
        """-- Warms it.
function Kettle.heat(a)
  if a then return true end
end
--- A local one.
local function sip() end
if x then
  function Hidden.f() end
end
""",
        [
            ('lua/func/Kettle.heat', 'func', 'Kettle.heat', 'function Kettle.heat(a)\n\nWarms it.', 2),
            ('lua/func/sip', 'func', 'sip', 'local function sip() end\n\nA local one.', 6),
        ],
    ),
    'protobuf': (
        """syntax = "proto3";
package tea.v1;

// A Cup is one cup.
message Cup {
  string id = 1;
  message Saucer { int32 w = 1; }
}

// Cups serves.
service Cups {
  // Fill fills.
  rpc Fill(FillRequest) returns (FillResponse);
}

// Tint lists.
enum Tint { NONE = 0; }
""",
        [
            ('proto/message/Cup', 'message', 'tea.v1 > Cup', 'message Cup {\n  string id = 1;\n  message Saucer { int32 w = 1; }\n}\n\nA Cup is one cup.', 5),
            ('proto/message/Cup.Saucer', 'message', 'tea.v1 > Cup.Saucer', 'message Saucer { int32 w = 1; }', 7),
            ('proto/service/Cups', 'service', 'tea.v1 > Cups', 'service Cups\n\nCups serves.', 11),
            ('proto/rpc/Cups.Fill', 'rpc', 'tea.v1 > Cups.Fill', 'rpc Fill(FillRequest) returns (FillResponse)\n\nFill fills.', 13),
            ('proto/enum/Tint', 'enum', 'tea.v1 > Tint', 'enum Tint { NONE = 0; }\n\nTint lists.', 17),
        ],
    ),
    'hcl': (
        """# The net.
module "net" {
  source = "./net"
}

resource "store" "logs" {
  name = "x"
  rule {
    on = true
  }
}
module "net" {
}
""",
        [
            ('hcl/block/module.net', 'block', 'module.net', 'module "net" {\n  source = "./net"\n}\n\nThe net.', 2),
            ('hcl/block/resource.store.logs', 'block', 'resource.store.logs', 'resource "store" "logs" {\n  name = "x"\n  rule {\n    on = true\n  }\n}', 6),
            ('hcl/block/resource.store.logs.rule', 'block', 'resource.store.logs.rule', 'rule {\n    on = true\n  }', 8),
            ('hcl/block/module.net~1', 'block', 'module.net', 'module "net" {\n}', 12),
        ],
    ),
    'bash': (
        """#!/usr/bin/env bash
# Brews tea.

# Heats water.
heat() {
  echo hi
}

# Where cups are.
SHELF=/srv/cups

TMP=/tmp/x
if true; then
  # Not here.
  X=1
fi
""",
        [
            ('sh/header', 'package', 'script', 'Brews tea.', 1),
            ('sh/func/heat', 'func', 'heat', 'heat()\n\nHeats water.', 5),
            ('sh/var/SHELF', 'value', 'SHELF', 'SHELF=/srv/cups\n\nWhere cups are.', 10),
        ],
    ),
}

SOURCES["yaml"] = (
    """# The kettle.
kind: Deployment
metadata:
  name: kettle
spec:
  replicas: 2
---
kind: Service
ports:
  - port: 80
---
a:
  b: 1
""",
    [
        ("yaml/doc/Deployment/kettle", "document", "Deployment/kettle", "kind: Deployment\nmetadata:\n  name: kettle\nspec:\n  replicas: 2\n\nThe kettle.", 2),
        ("yaml/key/Deployment/kettle.metadata", "section", "Deployment/kettle > metadata", "metadata:\n  name: kettle", 3),
        ("yaml/key/Deployment/kettle.spec", "section", "Deployment/kettle > spec", "spec:\n  replicas: 2", 5),
        ("yaml/doc/Service", "document", "Service", "kind: Service\nports:\n  - port: 80", 7),
        ("yaml/key/Service.ports", "section", "Service > ports", "ports:\n  - port: 80", 9),
        ("yaml/doc/doc2", "document", "document", "a:\n  b: 1", 11),
        ("yaml/key/doc2.a", "section", "a", "a:\n  b: 1", 12),
    ],
)

#: A document with all that a chunker of markdown must tell apart; chunks as above, but with their whole text.
MARKDOWN = """---
title: The Kettle
tags: [tea, water]
---

# Kettles

All about [kettles](k.md "hint"), ![a picture](p.png) and [[Cups|the cups]].

<!-- toc -->
- [x](#x)
<!-- tocstop -->

## Contents

- Heat
- Pour

## Heat & *Boil*!

Water boils. <!-- a note -->

```sh
# not a heading
```

### Deep

Deeper words.

Set text
--------

Under it.

> ## quoted

- ## listed

## Heat & *Boil*!

## ···
"""
MARKDOWN_CHUNKS = [
    ("title", "title", "", "The Kettle\n\ntags: tea, water", 1),
    ("body/0/kettles/path", "path", "# Kettles", "# Kettles", 6),
    ("body/0/kettles/narrow", "narrow", "# Kettles", "# Kettles\n\nAll about kettles, a picture and the cups.", 6),
    (
        "body/0/kettles/full", "full", "# Kettles",
        "# Kettles\n\nAll about kettles, a picture and the cups.\n\n## Contents\n\n- Heat\n- Pour\n\n## Heat & *Boil*!\n\nWater boils. \n\n```sh\n# not a heading\n```\n\n### Deep\n\nDeeper words.\n\n"
        "Set text\n--------\n\nUnder it.\n\n> ## quoted\n\n- ## listed\n\n## Heat & *Boil*!\n\n## ···", 6,
    ),
    ("body/2/heat-boil/path", "path", "# Kettles > ## Heat & *Boil*!", "# Kettles > ## Heat & *Boil*!", 19),
    ("body/2/heat-boil/narrow", "narrow", "# Kettles > ## Heat & *Boil*!", "# Kettles > ## Heat & *Boil*!\n\nWater boils. \n\n```sh\n# not a heading\n```", 19),
    ("body/2/heat-boil/full", "full", "# Kettles > ## Heat & *Boil*!", "# Kettles > ## Heat & *Boil*!\n\nWater boils. \n\n```sh\n# not a heading\n```\n\n### Deep\n\nDeeper words.", 19),
    ("body/3/deep/path", "path", "# Kettles > ## Heat & *Boil*! > ### Deep", "# Kettles > ## Heat & *Boil*! > ### Deep", 27),
    ("body/3/deep/narrow", "narrow", "# Kettles > ## Heat & *Boil*! > ### Deep", "# Kettles > ## Heat & *Boil*! > ### Deep\n\nDeeper words.", 27),
    ("body/4/set-text/path", "path", "# Kettles > ## Set text", "# Kettles > ## Set text", 31),
    ("body/4/set-text/narrow", "narrow", "# Kettles > ## Set text", "# Kettles > ## Set text\n\n--------\n\nUnder it.\n\n> ## quoted\n\n- ## listed", 31),
    ("body/5/heat-boil/path", "path", "# Kettles > ## Heat & *Boil*!", "# Kettles > ## Heat & *Boil*!", 40),
    ("body/6/section/path", "path", "# Kettles > ## ···", "# Kettles > ## ···", 42),
]

#: A document of links of all kinds, and what it links (target, anchor, kind, line).
LINKS = """---
name: links
---
Inline [one](a.md), [two](b.md#top "title"), [three](<c d.md>), ![no](p.png), [own](#here), [out](https://x.org/a.md), [mail](mailto:a@b.c).
[query](d.md?x=1#y?z) and [root](/e/f.md) and [nested `code.md` label](g.md).
Mentions `pkg/run.go`, `notes.md#part`, `.md`, `a b.md`, `x.txt`, ``two`ticks.md``.
Wiki [[Page]], [[Page Two|label]], [[Deep/Page#Part|l]], ![[embed]], `[[not]]`.
[ref] and [text][Ref] and [gone][nowhere].

[ref]: r.md#s

    indented [no](no.md)

```
[no](no.md) [[no]]
```
[quiet](q.md) <!-- lodestone-ignore -->
<!-- lodestone-ignore-next-line -->
[quiet](q.md)
[last](l.md)
"""
LINK_ROWS = [
    ("a.md", "", "md", 4), ("b.md", "top", "md", 4), ("c d.md", "", "md", 4), ("d.md", "y", "md", 5), ("/e/f.md", "", "md", 5), ("g.md", "", "md", 5),
    ("pkg/run.go", "", "code", 6), ("notes.md", "part", "code", 6), ("two`ticks.md", "", "code", 6),
    ("Page", "", "wiki", 7), ("Page Two", "", "wiki", 7), ("Deep/Page", "Part", "wiki", 7), ("embed", "", "wiki", 7),
    ("r.md", "s", "md", 8), ("r.md", "s", "md", 8), ("l.md", "", "md", 20),
]
SILENT = "# Quiet\n\n[a](a.md) <!-- lodestone-ignore-file -->\n\n## One\n\n## Two\n"

#: Files, links (src, target, anchor, kind, line) of every form, and the file each means.
GRAPH_FILES = ["a.md", "docs/b.md", "docs/c.markdown", "docs/Dynamic Models.md", "docs/data", "x/run.go", "y/run.go", "deep/er/z.md", "v1.2.md"]
GRAPH_LINKS = [
    ("docs/b.md", "../a.md", "", "md", 1, "a.md"), ("docs/b.md", "../a", "", "md", 2, "a.md"), ("a.md", "docs/c", "", "md", 3, "docs/c.markdown"), ("a.md", "docs/data", "", "md", 4, "docs/data"),
    ("a.md", "docs/Dynamic%20Models.md", "", "md", 5, "docs/Dynamic Models.md"), ("docs/b.md", "/deep/./er//z.md", "", "md", 6, "deep/er/z.md"), ("deep/er/z.md", "../../docs/b.md", "x", "md", 7, "docs/b.md"),
    ("a.md", "v1.2", "", "md", 8, None), ("a.md", "ghost.md", "", "md", 9, None), ("a.md", "docs", "", "md", 10, None), ("a.md", "p.png", "", "md", 11, None), ("a.md", "%zz.md", "", "md", 12, None),
    ("a.md", "B", "", "wiki", 13, "docs/b.md"), ("a.md", "docs/b", "", "wiki", 14, "docs/b.md"), ("docs/b.md", "/docs/b.md", "", "wiki", 15, "docs/b.md"), ("a.md", "run", "", "wiki", 16, "x/run.go"), ("a.md", "none", "", "wiki", 17, None),
    ("a.md", "run.go", "", "code", 18, "x/run.go"), ("docs/b.md", "c.markdown", "", "code", 19, "docs/c.markdown"), ("docs/b.md", "../a.md", "", "code", 20, "a.md"), ("docs/b.md", "nope.go", "", "code", 21, None),
    ("a.md", "./docs/../docs/b.md", "", "md", 22, "docs/b.md"), ("a.md", "../out.md", "", "md", 23, None),
]

#: Documents with findings, and what a rewrite makes of them.
FIX_FILES = ["d/e/n.md", "pkg/run.go", "x/s.go", "y/s.go", "d/e/m.md"]
FIX_TEXTS = {
    "d/e/n.md": "See `run.go` and [`run.go`](z) and `run.go`.\nNot `s.go` nor `no.go`.\n[deep](../../pkg/run.go) and [again](../../pkg/run.go#L1)\n",
    "d/e/m.md": "Nothing [near](n.md).\n",
}
FIXED = {
    "d/e/n.md": "See [`run.go`](/repo/pkg/run.go) and [`run.go`](z) and [`run.go`](/repo/pkg/run.go).\nNot `s.go` nor `no.go`.\n[deep](/repo/pkg/run.go) and [again](/repo/pkg/run.go#L1)\n",
}
REWRITES = [("deep", "../../pkg/run.go", "/repo/pkg/run.go", 1), ("deep", "../../pkg/run.go#L1", "/repo/pkg/run.go#L1", 1), ("unlinked", "run.go", "/repo/pkg/run.go", 2)]

#: Documents, their list of contents (missing, stale, current or none), and the text with it written.
CONTENTS = {
    "missing.md": ("# T\n\nintro\n\n## One\n\n### Sub\n\n## Two\n", "missing", "# T\n\nintro\n\n## Contents\n\n- One\n  - Sub\n- Two\n\n## One\n\n### Sub\n\n## Two\n"),
    "stale.md": ("# T\n\n## Table of contents\n\n- Old\n\n## One\n", "stale", "# T\n\n## Table of contents\n\n- One\n\n## One\n"),
    "current.md": ("# T\n\n## Contents\n\n- One\n\n## One\n", None, None),
    "none.md": ("# T\n\nno sections\n", None, None),
    "front.md": ("---\na: 1\n---\n## One\n", "missing", "---\na: 1\n---\n\n## Contents\n\n- One\n\n## One\n"),
    "silent.md": (SILENT, None, None),
    "last.md": ("## One\n\n## Contents\n\n- Old\n", "stale", "## One\n\n## Contents\n\n- One\n"),
}
