"""Quays of a harbour and the ships that lie there, under every kind of rule."""

from granary.plans.engine import Engine

QUAYS = """CREATE TABLE quays (no INT AUTO_INCREMENT PRIMARY KEY, label VARCHAR(40) NOT NULL UNIQUE, side VARCHAR(10), depth DECIMAL(4,1) DEFAULT 9.5);
INSERT INTO quays (label, side, depth) VALUES ('Amber', 'north', 12.0), ('Basalt', 'south', 7.5), ('Cobalt', 'south', NULL), ('Drift', 'east', 4.5);"""
SHIPS = """CREATE TABLE ships (
  sign CHAR(5) PRIMARY KEY, title VARCHAR(60) NOT NULL, crew SMALLINT NOT NULL DEFAULT 2 CHECK (crew BETWEEN 0 AND 900), tons DECIMAL(9,1),
  quay INT, launched DATE, rig ENUM('tanker', 'ferry', 'tug') DEFAULT 'tug',
  CONSTRAINT lies_at FOREIGN KEY (quay) REFERENCES quays (no) ON DELETE SET NULL);
INSERT INTO ships (title, sign, rig, crew, tons, quay, launched) VALUES
  ('Ostrava', 'OS1', 'tanker', 24, 81000.5, 1, '2011-06-30'), ('Pelagia', 'PE2', 'ferry', 61, 9200, 2, '1998-02-14'), ('Quokka', 'QU3', 'tug', 5, 310.2, 2, '2020-11-01'),
  ('Riverine', 'RI4', 'ferry', 33, 4100, 4, '2005-08-19'), ('Sable Star', 'SA5', 'tanker', 19, 56000, NULL, '2017-01-25'), ('Tern', 'TE6', 'tug', 0, 280, NULL, NULL);"""


def harbour(spark) -> Engine:
    e = Engine(spark)
    e.run(QUAYS + SHIPS)
    return e


def rows(e: Engine, sql: str) -> list[tuple]:
    return [tuple(r) for r in e.sql(sql).collect()]


def column(e: Engine, sql: str) -> list:
    return [r[0] for r in rows(e, sql)]


def one(e: Engine, sql: str):
    return column(e, sql)[0]
