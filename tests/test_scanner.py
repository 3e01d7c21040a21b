"""Symbols of five languages against lists written by hand beside each sample.

A definition is `first-last name`, a use `line name`; a use is what a reader would follow: calls,
fields and members, types where the language's table counts them.
"""

from collections import Counter

import pytest

from quarry import scanner

GO = '''package harbour

import (
	"fmt"
	m "x/math"
)

// Boat { is not code
type Boat struct {
	Length int
	Crew   []*Sailor
	Owner  *port.Owner
	Engine
}

type (
	Sailor struct{ Name string }
	Mover  interface {
		Move(to Place, by int) (Place, error)
		fmt.Stringer
	}
	Visit func(b Boat) error
)

func (b *Boat) Move(to Place, by int) (Place, error) {
	x := b.Length + `raw { `
	if len(x) > 3 {
		return Place{to, 1}, nil
	}
	fmt.Println("}", x, '{')
	s := make([]Sailor, 3)
	var e Engine = newEngine(s)
	for _, c := range b.Crew {
		c.Greet()
	}
	go func(p Place) { m.Sail(p) }(to)
	if v, ok := e.(Mover); ok {
		v.Move(to, by)
	}
	return to.Next(), nil
}

func build(items map[string]Item, f func(Item) Boat) []Boat { return nil }
'''
GO_DEFS = "9-14 Boat, 17-17 Sailor, 18-21 Mover, 22-22 Visit, 25-41 Move, 43-43 build"
GO_USES = "11 Sailor, 12 Owner, 13 Engine, 19 Place, 19 Place, 20 Stringer, 22 Boat, 25 Boat, 25 Place, 25 Place, 26 Length, 27 len, 28 Place, 30 Println, 31 make, 31 Sailor, 32 Engine, 32 newEngine, 33 Crew, 34 Greet, 36 Place, 36 Sail, 37 Mover, 38 Move, 40 Next, 43 Item, 43 Item, 43 Boat, 43 Boat"

RUST = r'''use std::collections::HashMap;

/// A boat { in a comment.
#[derive(Debug)]
pub struct Boat<'a> {
    name: &'a str,
    crew: Vec<Sailor>,
}

enum Wind { Calm, Gale(u8) }

pub trait Mover {
    fn step(&mut self, by: i32) -> Result<(), Error>;
    fn twice(&mut self) { self.step(2); }
}

impl Mover for Boat {
    fn step(&mut self, by: i32) -> Result<(), Error> {
        let q = '{';
        let r = r#"a "raw" } "#;
        self.name.trim();
        println!("{} }}", by);
        let map = HashMap::new();
        tide::level(by, Wind::Calm)
    }
}

impl Sailor {
    pub const LIMIT: usize = 4;
    pub async fn greet(&self) -> String {
        /* a /* nested } */ comment */
        let c = self.crew.len();
        helper(c);
        format_name::<u8>(c)
    }
}

type Pair = (Boat, Boat);
mod tests { fn inner() {} }
macro_rules! shout { ($x:expr) => { $x }; }
fn free(b: &Boat, w: Wind) -> bool { b.crew.is_empty() && Sailor::LIMIT > 3 }
'''
RUST_DEFS = "5-8 Boat, 10-10 Wind, 12-15 Mover, 14-14 twice, 18-25 step, 30-35 greet, 38-38 Pair, 39-39 tests, 39-39 inner, 40-40 shout, 41-41 free"
RUST_USES = "1 std, 1 collections, 1 HashMap, 14 step, 17 Mover, 21 name, 21 trim, 22 println, 23 HashMap, 23 new, 24 tide, 24 level, 24 Wind, 24 Calm, 28 Sailor, 32 crew, 32 len, 33 helper, 41 crew, 41 is_empty, 41 Sailor, 41 LIMIT"

TYPESCRIPT = r'''import { Sailor } from "./sailor";

export interface Mover extends Base {
  speed: Speed;
  move(to: Place, by?: number): Place;
}

export abstract class Boat implements Mover {
  private owner: Owner;
  static count = 0;
  pattern = /[{/"]+/g;
  constructor(readonly name: string, crew: Sailor) { this.owner = crew.boss; }
  abstract stop(): void;
  get length(): number { return this.measure(2) / 3 / this.count; }
  async move<T>(to: Place, by?: number): Promise<T> {
    const text = `a } ${this.show(`in ${to.name} {`)} b`;
    if (by) { return Tide.wait(to); }
    for (const c of this.crew) { c.greet("}"); }
    return new Trip(to).go();
  }
}

type Pair = { a: Boat; b: Boat };
enum Wind { Calm, Gale = 3 }
declare module Harbour { function dock(b: Boat): void; }
export function build(items: Item[], one: Boat): Boat {
  let e: Engine = makeEngine(items);
  const f = (w: Wind) => w.strength;
  const o = { render() { return f(Wind.Calm); }, plain: e.start };
  return o.plain ? e.boat() : one;
}
'''
TYPESCRIPT_DEFS = "3-6 Mover, 5-5 move, 8-21 Boat, 12-12 constructor, 13-13 stop, 14-14 length, 15-20 move, 23-23 Pair, 24-24 Wind, 25-25 Harbour, 25-25 dock, 26-31 build, 29-29 render"
TYPESCRIPT_USES = "4 Speed, 5 Place, 5 Place, 9 Owner, 12 Sailor, 12 owner, 12 boss, 14 measure, 14 count, 15 Place, 16 show, 16 name, 17 Tide, 17 wait, 18 crew, 18 greet, 19 Trip, 19 go, 23 Boat, 23 Boat, 25 Boat, 26 Boat, 26 Boat, 27 Engine, 27 makeEngine, 28 Wind, 28 strength, 29 f, 29 Wind, 29 Calm, 29 start, 30 plain, 30 boat"

JAVA = r'''package harbour.core;

import java.util.List;

/** A boat { in a comment. */
@Entity(name = "boat")
public class Boat extends Vessel implements Mover, Named<String> {
    static final int LIMIT = 3;
    private final List<Sailor> crew;
    char q = '{';

    public Boat(List<Sailor> crew) {
        super(crew);
        this.crew = crew;
    }

    @Override
    public Place move(Place to, int by) throws TideException {
        String s = """
            text } with "quotes"
            """;
        if (by > LIMIT) { return Place.of(to); }
        for (Sailor c : crew) { c.greet("}"); }
        Trip t = new Trip(to) { void stop() { halt(); } };
        return t.go().last;
    }

    abstract static class Engine { abstract int power(Fuel f); }
    enum Wind { CALM, GALE; int force() { return ordinal(); } }
}

interface Mover extends Named, Closeable {
    Place move(Place to, int by);
    default void twice() { move(Place.HOME, 2); }
}
'''
JAVA_DEFS = "6-30 Boat, 17-26 move, 24-24 stop, 28-28 Engine, 28-28 power, 29-29 force, 32-35 Mover, 33-33 move, 34-34 twice"
JAVA_USES = "7 Vessel, 7 Mover, 14 crew, 22 Place, 22 of, 23 greet, 24 Trip, 24 halt, 25 go, 25 last, 29 ordinal, 32 Named, 32 Closeable, 34 move, 34 Place, 34 HOME"

C = r'''#include <stdio.h>
#define CALL(x) \
    dropped(x)

/* a boat { in a comment */
struct boat {
    int length;
    struct sailor *crew;
};

typedef struct { int x, y; } place;
typedef int (*visit)(struct boat *);
enum wind { CALM, GALE = 3 };
union word { int i; float f; };
union word both;

static int move(struct boat *b, place to);
extern void hide(void);

static int move(struct boat *b, place to) {
    char q = '{', *s = "} \" ";
    if (b->length > 3 && to.x) {
        return tide_level(b->crew->age, sizeof(struct boat));
    }
    while (next(b)) { printf("%s}", s); }
    return (int) squared(to.y);
}

struct boat *find(const char *name) { return lookup(name)->boat; }
'''
C_DEFS = "6-9 boat, 11-11 place, 12-12 visit, 13-13 wind, 15-15 word, 17-17 move, 18-18 hide, 20-20 move, 29-29 find"
C_USES = "22 length, 22 x, 23 tide_level, 23 crew, 23 age, 25 next, 25 printf, 26 squared, 26 y, 29 lookup, 29 boat"

SAMPLES = {"go": (GO, GO_DEFS, GO_USES), "rust": (RUST, RUST_DEFS, RUST_USES), "typescript": (TYPESCRIPT, TYPESCRIPT_DEFS, TYPESCRIPT_USES), "java": (JAVA, JAVA_DEFS, JAVA_USES), "c": (C, C_DEFS, C_USES)}


def measured(got, want):
    """(recall, precision) of two bags."""
    both = (Counter(got) & Counter(want)).total()
    return both / len(want), both / max(1, len(got))


@pytest.mark.parametrize("language", SAMPLES)
def test_samples(language):
    text, defs, uses = SAMPLES[language]
    found, used = scanner.scan(text, language)
    got = [f"{d.start_line}-{d.end_line} {d.name}" for d in found], [f"{u.start_line} {u.name}" for u in used]
    for have, want in zip(got, (defs, uses)):
        want = want.split(", ")
        recall, precision = measured(have, want)
        gap = sorted((Counter(want) - Counter(have)).elements()), sorted((Counter(have) - Counter(want)).elements())
        assert recall >= 0.95 and precision >= 0.95, gap
    assert len({(u.start, u.name) for u in used}) == len(used)  # one place, one use
    assert not {u.start for u in used} & {d.start for d in found if d.start_line == d.end_line and text.startswith(d.name, d.start)}


@pytest.mark.parametrize("language", scanner.LANGUAGES)
def test_broken_text(language):
    """Unclosed strings, comments and brackets end with the text; nothing is an error."""
    for text in ("", "(", "{[(", "))}", '"', "'", "`${", "/*", "/* /*", "#", "fn", "func (", "class {", "type X =", "struct a", "é漢 = '\U0001f600'", "\x00", "<" * 500, "a.b.c::d->e " * 50):
        scanner.scan(text, language)
    text = SAMPLES[language][0]
    for k in range(0, len(text), 7):
        scanner.scan(text[:k], language)
        scanner.scan(text[k:], language)


@pytest.mark.parametrize("language", scanner.LANGUAGES)
def test_time_is_linear(language):
    import time

    text = SAMPLES[language][0]
    took = []
    for n in (60, 480):
        began = time.process_time()
        scanner.scan(text * n, language)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5
