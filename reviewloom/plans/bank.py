"""Snippets of code that the corpora are seeded with: hits and near misses of every rule.

``@NEAR@`` stands for the number of a neighbouring file and ``@FOLD@`` for its folder.
"""

from __future__ import annotations

_NESTED = "\n".join("  " * i + f"if (a{i}) {{" for i in range(9)) + "\n" + "}" * 9
_MAZE = "\n".join(f"while (b{i}) {{ if (c{i}) {{" for i in range(8)) + "\n" + "}" * 16

SNIPPETS: list[tuple[str, str]] = [
    ("js", "const total = eval (source);\nconst medieval = 1;\nevaluate(1);\neval\n('x');"),
    ("ts", "import { a } from './f@NEAR@';\nimport b from '@/m@FOLD@/f@NEAR@';\nconst f = new Function ('x', 'y');\nnew Functional(1);"),
    ("js", "box.innerHTML = text;\nbox.innerHTML\n = more;\nread(box.innerHTML);\nbox.textContent = text;"),
    ("tsx", "<div dangerouslySetInnerHTML={{ __html: x }} />\n<div setInnerHTML={x} />"),
    ("js", "document.write (page);\ndocument.writeln(page);\nwindow.location = next;\nwindow.locations.push(next);"),
    ("ts", "db.run(`select ${name} from t`).then(r => r.query (1));\nconst s = `${a}`; const q = 1;\nx = `${id}` + execute(sql);"),
    ("py", "password = 'hunter2'\nAPI_KEY: \"abc123\"\ntoken = ''\nsecret = os.environ['S']\nApiKey='k1'"),
    ("js", "console.log('password is', p);\nCONSOLE.WARN(\"Token\");\nconsole.log(password);\nlogger.info('secret');"),
    ("js", "exec('ls');\nspawn(`rm ${x}`);\nexecSync(\"pwd\");\nspawnSync ( 'id' );\nexecFile('ls');"),
    ("js", "const r = Math.random ();\nconst s = Math.random(7);\nconst t = Math.random() + Math.random();"),
    ("ts", "Object.assign ( { ...a });\nSpread({...b});\nObject.assign(a, b);\nconst raw = atob (data);\nbtoa(data);"),
    ("js", "const q = await a(await b(await c()));\np.then(x).then(y).then(z);\nawait one;\nawait two; await three;"),
    ("ts", "import { z } from 'lib/f@NEAR@';\nrows.map (async r => load(r));\nrows.map(r => r.id);\nconst copy = JSON.parse( JSON.stringify(x));\nJSON.stringify(JSON.parse(y));"),
    ("js", "for (let i = 0; i < n; i++) { const d = 1; document.body.append(d); }\nwhile (x) { documents.push(1) }\nfor (;;) {\n  DOM.touch();\n}"),
    ("js", "setInterval (tick, 50);\nsetInterval(tick, 500);\nsetTimeout('go()', 9);\nsetInterval( `go()`, 1000);\nsetTimeout(go, 9);"),
    ("ts", "const a = new RegExp (p);\nconst b = new RegExp();\nconst c = /x/;\nnew RegExp(p + '(');"),
    ("js", "try { run(); } catch (e) { }\ntry {\n  run();\n} catch (err) {\n}\ntry { run(); } catch (e) { log(e); }\ntry { a() } catch { }"),
    ("tsx", "useEffect ( () => {\n  fetch(url);\n}, []);\nuseState(() => { return 1; });\nuseMemo(() => { fetch(url) });"),
    ("py", "exec (body)\nmod = __import__ ('os')\nimport_('os')\ndata = pickle.load (f)\ndata = pickle.loads(b)\npickle.dump(x, f)"),
    ("py", "os.system ('ls')\nos.systems\nsubprocess.call ( 'ls -l' )\nsubprocess.call(['ls'])\nsubprocess.run('ls')"),
    ("py", "a = yaml.load (f)\nb = yaml.load(f, Loader=yaml.SafeLoader)\nc = yaml.safe_load(f)\nd = yaml.load(yaml.load(g), Loader) or yaml.load(h)"),
    ("py", "q = SQL + 'where x'\nr = SQL + f\"{y}\"\ns = SQL + rest\nt = mysql + 'x'\nfor i in range(len(rows)):\n    pass\nfor row in range (len (rows)):\n    pass\nfor r in rows: pass"),
    ("java", "public class A {\n  Process p = Runtime.getRuntime().exec(cmd);\n  Runtime.getRuntime().gc();\n  ObjectInputStream in;\n  XMLReader x; SAXParser s; DocumentBuilder d;\n  XmlReader y;\n}"),
    ("go", "package main\nimport \"os\"\nfunc main() {\n  os.Exec (\"ls\")\n  os.Exit(1)\n  template.HTML (x)\n  template.HTMLEscape(x)\n}"),
    ("rs", "pub fn main() {\n  unsafe { go() }\n  unsafe fn x() {}\n}\nimpl A for B {}\nenum C { D }"),
    ("sql", "delete from t;\nDROP  FROM u;\nTruncate\nFrom v;\nDELETE t;\ninsert into w;"),
    ("js", "rows.forEach (async r => save(r));\nrows.forEach(r => save(r));\nvar a = 1;\nlet variable = 2;\nvariance = 3;\nvar\tb;"),
    ("js", "console.error('x');\nconsole.table(x);\ns += 'a';\ns +\n= \"b\";\ns + = 'c';\ns += t;\nimport * as all from './f@NEAR@.js';\nimport all from 'x';"),
    ("java", "class B extends C {\n  StringBuffer a = new StringBuffer (1);\n  StringBuilder b = new StringBuilder();\n  boolean c = x.equals (\"y\") || x.equals(z);\n}"),
    ("js", "while (true) { step(); }\nwhile ( true\n) { }\nwhile (truey) { }\ncatch (e) {}\nconst g = x=>y; const h = x => y;"),
    ("php", "<?php\necho 1;\nrequire('f@NEAR@');\nrequire_once('x');"),
    ("c", "#include <stdio.h>\nint main() { return 0; }\n"),
    ("ts", "import c from '/m@FOLD@/f@NEAR@.ts';\nconst d = await import ( 'x/f@NEAR@' );\nimport type { T } from './t';\nimport './side';\n" + _NESTED),
    ("ts", "import d from '@/nowhere';\n" + _MAZE + "\nelse if (x) { } else { }\nfunction go(a) { switch (a) { case 1: do { } while (b) } }"),
    ("vue", "<script>\nimport n from '../f@NEAR@';\nif (a) { (b[c]) }\n</script>\n)))(((\n[[[[ ]]]]"),
    ("js", "café = eval(1); naïve_if = 2; éif(x); ifé(y);\nélse if (z) { }\nfunction é() { return x=>é; }"),
]
