"""Components and data flows by structure: nested declarations, several names of one keyword, comments, strings, type arguments."""

from sparkloom.operators import extract

SOURCE = r'''
// const Ghost = () => <div/>;
/* function Phantom() { return <p/>; } */
import React, { useState } from "react";
export interface PanelProps { title: string; size?: number }
const notOne = "function Fake() { return <div/> }", Lower = 5;
export default function Panel({ title }: PanelProps) {
  const [a, setA] = useState<Map<string, number>>(new Map());
  const theme = useContext(ThemeContext);
  const Inner = () => { const r = useReducer(f, 0); return <Leaf name="x" />; };
  function Deep() { return <><Twig.Item /></>; }
  return (
    <section>type class const text<b>bold</b> {a ? <Inner/> : <Deep />}
      it's a text // with "quotes
    </section>
  );
}
  const Indented = memo(() => <div>
function inText() now
  <Panel title={`t${1}`} /></div>);
export const First = (p: Array<string>) => <First.Part>{useQuery<Item[]>("k").data}</First.Part>, Second: React.FC<PanelProps> = ({ title }) => <Indented>{title}</Indented>, third = 3;
export class Old extends React.Component { render() { return <div/>; } }
const Plain = () => 5;
const Generic = <T extends object>(x: T) => { useStoreThing(); const s = useCartStore(); const d = useAppDispatch(); const q = useSelector(pick); return null; };
async function Loader() { const r = await fetch("/api"); axios.get("/b"); const { data } = useSWR("/c"); return <Old/>; }
'''


def test_declarations_by_structure(spark):
    files = spark.createDataFrame([("src/p.tsx", SOURCE, 0), ("src/none.tsx", "", 1), ("src/a.ts", "const A = <div/>", 2), ("src/q.jsx", "const Only = () => <a/>", 3)], "path string, text string, ord long")
    found = {(r.name, r.kind) for r in extract.declarations(files.where("path = 'src/p.tsx'")).collect()}
    assert {("Panel", "function"), ("Indented", "const"), ("First", "const"), ("Second", "var"), ("third", "var"), ("Old", "class"), ("Plain", "const"), ("Generic", "const"), ("Loader", "function"), ("PanelProps", "interface"), ("Lower", "var")} <= found
    assert not {n for n, _ in found} & {"Ghost", "Phantom", "Fake", "Inner", "Deep", "inText", "text"}
    comps = {r.name: r for r in extract.components(files).collect()}
    assert set(comps) == {"Panel", "Indented", "First", "Second", "Loader", "Only"}
    panel = comps["Panel"]
    assert panel.hooks == ["useState", "useContext", "useReducer"] and panel.children == ["Leaf", "Twig.Item", "Inner", "Deep"]
    assert [(p.name, p.type, p.is_required) for p in panel.props] == [("title", "string", True), ("size", "number", False)]
    assert panel.is_default_export and not comps["First"].is_default_export
    assert comps["Indented"].children == ["Panel"] and comps["First"].children == ["First.Part"] and comps["First"].hooks == ["useQuery"] and comps["Second"].children == ["Indented"]


def test_flows_of_every_kind(spark):
    files = spark.createDataFrame([("src/p.tsx", SOURCE, 0)], "path string, text string, ord long")
    got = {(r.component_name, r.type, r.name) for r in extract.data_flows(files).collect()}
    assert {("Panel", "context", "ThemeContext"), ("Panel", "local-state", "useState"), ("Panel", "local-state", "useReducer"), ("Panel", "props", "props")} <= got
    assert {("Generic", "store", "redux"), ("Generic", "store", "redux-dispatch"), ("Generic", "store", "useCartStore")} <= got
    assert {("Loader", "api", "fetch"), ("Loader", "api", "useSWR")} <= got and ("First", "api", "useQuery") in got
    assert not {x for x in got if x[0] in ("Inner", "Deep", "Ghost")}
