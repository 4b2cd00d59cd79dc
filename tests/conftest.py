import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def commit(repo, message="change"):
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=Test", "-c", "user.email=test@example.invalid", "commit", "-qm", message], check=True)


def write(repo, files):
    for name, text in files.items():
        path = Path(repo) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8")


#: A small shop: scripts that wrap and read tables, components that show values, SQL in two versions, two Python modules.
SHOP = {
    "src/api.ts": """export async function saveTicket(db, ticket) {
  await runProcedure(db, 'save_ticket', ticket);
  return table(db, 'tickets').upsert(ticket);
}

function runProcedure(db, name, payload) {
  return db.rpc(name!, {payload});
}

function table(db, which) {
  return db.from((which) as string);
}
""",
    "src/list.ts": """export const listTickets = async (db) => {
  const {data} = await db.from('tickets').select('id, title');
  return data;
};
""",
    "src/checks.ts": """export function findConflicts(rows) {
  const slots = new Map();
  return rows.filter((row) => slots.has(row.slot) || !slots.set(row.slot, row));
}
""",
    "src/board.tsx": """import {useMemo} from 'react';
import {findConflicts} from './checks';

export function Board({rows}) {
  const clashes = useMemo(() => findConflicts(rows), [rows]);
  const totals = useMemo(() => {
    return {open: rows.length, clashing: clashes.length};
  }, [rows, clashes]);
  return (
    <section>
      <Figure value={totals.clashing} detail="Conflicts / Gaps" />
    </section>
  );
}
""",
    "tests/api.test.ts": """import {saveTicket} from '../src/api';

test('a ticket is saved', async () => {
  await saveTicket(fakeDb(), {id: 1});
});
""",
    "migrations/001_tickets.sql": """create table if not exists public.tickets (id bigint, title text);

create or replace function public.save_ticket(payload jsonb)
returns void language sql as $body$
  insert into public.tickets (id, title) select (payload->>'id')::bigint, payload->>'title';
$body$;
""",
    "migrations/002_tickets.sql": """create or replace function public.save_ticket(payload jsonb)
returns void language sql as $body$
  update public.tickets set title = payload->>'title' where id = (payload->>'id')::bigint;
$body$;
""",
    "shop/clean.py": """def tidy_ticket(title):
    words = title.split()
    return " ".join(words)
""",
    "shop/service.py": """from shop.clean import tidy_ticket


class Base:
    def run(self):
        return tidy_ticket("x")


class Special(Base):
    pass
""",
    "README.md": "# Shop\n",
}


@pytest.fixture()
def shop(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    write(repo, SHOP)
    commit(repo, "start")
    return repo
