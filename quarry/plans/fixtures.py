"""Small inputs of kinds that the test tables lack: code, Markdown, configuration, CSV."""

CODE = [
    (1, "src/auth/jwt.service.ts", "function", "typescript", "verifyToken", "export async function verifyToken(token: string, secret: string): Promise<User> {\n  // check the token\n  if (!token) throw new Error('no token');\n  const payload = await jwt.verify(token, secret);\n  console.log(payload);\n  return payload as User;\n}"),
    (2, "src/db/user.repository.ts", "class", "typescript", "UserRepository", "import { Repository } from 'typeorm';\n\n@Injectable()\nexport class UserRepository {\n  static instance = null;\n  find(id) {\n    return this.db.find(id);\n  }\n\n  save(user) {\n    return this.db.save(user);\n  }\n}"),
    (3, "app.py", "function", "python", "main", "import os\nfrom fastapi import FastAPI\n\ndef main(argv):\n    # start\n    for a in argv:\n        if a:\n            while True:\n                if a == 'x':\n                    break\n    return os.environ"),
    (4, "tests/user.spec.ts", "function", "typescript", "test user", "describe('user', () => {\n  it('works', () => {\n    expect(createUser()).toBe(1);\n  });\n});"),
    (5, "src/events/bus.js", "class", "javascript", "Bus", "const EventEmitter = require('events');\nclass Bus extends EventEmitter {\n  publish(x) { this.emit('x', x); setTimeout(() => {}, 1); }\n}\nmodule.exports = Bus;"),
    (6, "main.go", "function", "go", "main", "package main\n\nimport \"fmt\"\n\nfunc main() {\n\tfmt.Println(\"hi\")\n\tif true {\n\t\treturn\n\t}\n}"),
    (7, "src/lib.rs", "function", "rust", "hash", "use std::collections::HashMap;\n\n/** doc */\n// TODO later\npub fn hash(x: u64) -> u64 {\n    x * 31\n}"),
    (8, "config/settings.js", "function", "javascript", "env", "const port = process.env.PORT || 3000;\nconst render = (a, b) => {\n  fetch('http://x');\n  return a;\n};\n\n\n\n// end"),
    (9, "docs/readme.md", "section", "markdown", "Intro", "# Title\n\nThis is a guide. It has sentences! Does it? Yes. It does. And more. And more still. The end."),
    (10, "src/util/strings.ts", "interface", "typescript", "IPadStrategy", "export interface IPadStrategy<T> {\n  pad(x: T): T;\n}\ntype A = string;"),
    (11, "db/migrations/seed.sql", "fallback", "sql", "seed", "INSERT INTO a VALUES (1);\nSELECT * FROM a;\n-- deprecated recursive query\nDELETE FROM a;"),
    (12, "src/api/router.ts", "function", None, "routes", "app.get('/x', (req, res, next) => { next(); });\nrouter.use(middleware);\nwindow.x = 1;\nprocess.exit(1);\n/* block */\n * note\n@param x y"),
]
MARKDOWN = [
    (1, "docs/a.md", "before\n# Title\ntext #tag1 and #tag2\n## One\n```\n# no heading\n```\nmore #tag1\n### Deep\nend"),
    (2, "readme.md", "no headings\njust #text here"),
    (3, "b/c.md", "## Only\n~~~\ncode\n~~~\n\n# Late\n#notatag1 x#y #z-1"),
    (4, "open.md", "# A\n```\nnever closed\n# B"),
]
JSON_FILES = [(1, "a.json", '{"name": "x", "deps": {"a": 1}, "list": [1, 2]}'), (2, "b.json", "[1, 2"), (3, "c.json", '"scalar"'), (4, "d.json", '{"only": null}')]
DOCKER = [(1, "Dockerfile", "# base\nFROM a\nENV X=1\nRUN b \\\n  c\nCOPY . .\nCMD run"), (2, "Dockerfile", "RUN x"), (3, "Dockerfile", "LABEL a=b\nUSER me")]
INI = [(1, "a.ini", "[a]\nx=1\n\n[b]\ny=2\n\n\nz=3"), (2, "b.ini", "\n\n"), (3, "c.ini", "one")]
CSV = [(1, "a.csv", 'id,"name",email\n1,"Ann",a@x\n\n2,Bob,b@x\n3,Cy,c@x'), (2, "b.csv", "h1, h2"), (3, "c.csv", "a\n1\n2\n3\n4\n5\n6\n7")]
