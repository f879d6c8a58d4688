"""A league derived from the star-schema test tables, by integer arithmetic only.

Customers are teams, orders are matches, order lines are player lines, parts are players. Used to run every transform
over whole tables of any size; the transforms themselves know nothing about it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON_ID = 3
COMPETITION_ID = 3
TODAY = "1999-06-01"
RUN_AT = "1999-06-01 12:00:00"

# Competition of each scope number.
CATEGORIES = (
    "Mayores", "Mayores", "Mayores", "Mayores", "Juniors", "Juniors", "Juveniles", "Cadetes", "Menores", "Infantiles",
)
DIVISIONS = (
    "LHC Hipotecario Seguros", "LHD Hipotecario Seguros", "Liga de Honor Plata", "Liga de Honor Plata", "A", "A", "A",
    "B", "A", "B",
)
CODES = ("A", "B", "C", "D")
CLUB_WORDS = ("Atlético", "Deportivo", "Sociedad", "Círculo", "Unión")
FIRST_NAMES = ("Ana", "José", "Lucía", "Martín", "Sofía", "Iñaki")
TIMES = ("", "18:00:00", "19:30:00", "20:15:00", "21:00:00")
LOGOS = ("", "https://img.example/c.png", "ftp://img.example/c.png", "http://u:p@img.example/c.png")
SHEET_LINKS = ("", "https://liga.example/p", "http://u@liga.example/p", "javascript:alert(1)")
POSITION_OF_TYPE = {
    "STANDARD": "Arquero", "ECONOMY": "Extremo", "MEDIUM": "Lateral", "PROMO": "Central", "LARGE": "Pivote",
}
SEASON_ROWS = (
    (1, "APERTURA", 1997, "apertura", 1, "1997-01-01", "1997-12-31"),
    (2, "CLAUSURA", 1998, "clausura", 2, "1998-01-01", "1998-12-31"),
    (3, "LIGA", 1999, "clausura", 3, "1995-01-01", "2001-12-31"),
)
GOALS = "(cast(l_quantity as int) % 10)"


def pick(values: tuple[str, ...], number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast(({number}) % {len(values)} as int) + 1)"


def _time(number: str) -> str:
    return f"nullif({pick(TIMES, number)}, '')"


def _club_name(club: str) -> str:
    """Every 50th club repeats its neighbour's name in other letters and spacing."""
    word, again = pick(CLUB_WORDS, club), pick(CLUB_WORDS, f"{club} - 1")
    return (
        f"CASE WHEN ({club}) % 50 = 0 AND ({club}) > 0 THEN concat(upper({again}), '  ', ({club}) - 1, '  NORTE') "
        f"ELSE concat({word}, ' ', {club}, ' Norte') END"
    )


class StarLeague:
    """League tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def team_count(self) -> int:
        return self.table("customer").agg(F.max("c_custkey") + 1).first()[0]

    @cached_property
    def player_count(self) -> int:
        return self.table("part").agg(F.max("p_partkey") + 1).first()[0]

    @cached_property
    def temporadas(self) -> DataFrame:
        rows = ", ".join(
            f"({i}L, '{name}', {year}, '{phase}', {competition}L, date'{start}', date'{end}')"
            for i, name, year, phase, competition, start, end in SEASON_ROWS
        )
        columns = "id, nombre, anio, fase, competencia_id, fecha_inicio, fecha_fin"
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

    @cached_property
    def equipos(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id",
            "c_custkey div 4 AS club_id",
            # Written over the key, so that joins on the season keep a key to join by.
            f"if(c_custkey >= 0, {SEASON_ID}L, 0L) AS temporada_id",
            f"{pick(CATEGORIES, 'c_custkey')} AS categoria",
            f"{pick(DIVISIONS, 'c_custkey')} AS division",
            "if(c_custkey % 2 = 0, 'M', 'F') AS rama",
            f"{pick(CODES, 'c_custkey')} AS equipo_codigo",
            "concat('Fed ', c_custkey) AS nombre_federacion",
            "c_custkey % 23 <> 0 AS activo",
        )

    @cached_property
    def clubes(self) -> DataFrame:
        """One club per four teams."""
        clubs = self.table("customer").where("c_custkey % 4 = 0").selectExpr("c_custkey div 4 AS id")
        return clubs.selectExpr(
            "id",
            f"{_club_name('id')} AS nombre",
            "if(id % 3 <> 0, concat('C', id), NULL) AS abreviatura",
            "if(id % 7 <> 0, concat('Ciudad ', id % 13), NULL) AS ciudad",
            f"nullif({pick(LOGOS, 'id')}, '') AS logo_url",
            "id % 37 <> 0 AS activo",
        )

    @cached_property
    def club_aliases(self) -> DataFrame:
        """A first alias per club, but for every sixth, and a short second one per ten."""
        aliases = self.clubes.selectExpr(
            "id AS club_id",
            "inline(array(struct(id * 2 AS id, 'Alias Norte ' AS word, id % 6 <> 0 AS given), "
            "struct(id * 2 + 1 AS id, 'CN ' AS word, id % 10 = 3 AS given)))",
        )
        return aliases.where("given").selectExpr(
            "id", "club_id", "concat(word, club_id) AS alias", "lower(concat(word, club_id)) AS alias_normalizado",
            "'oficial' AS fuente", "id % 9 <> 0 AS activo",
        )

    @cached_property
    def jugadores(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS id",
            f"{pick(FIRST_NAMES, 'p_partkey')} AS nombre",
            "concat('Pérez ', p_partkey) AS apellido",
            "date_add(date'1965-01-01', cast((p_partkey * 37) % 14000 as int)) AS fecha_nacimiento",
            f"if(p_partkey % 5 <> 0, {pick(('Derecho', 'Izquierdo'), 'p_partkey')}, NULL) AS brazo_habil",
            "if(p_partkey % 4 <> 0, double(p_size + 150), NULL) AS altura_cm",
            "if(p_partkey % 6 <> 0, double(p_size + 50), NULL) AS peso_kg",
        )

    @cached_property
    def pairings(self) -> DataFrame:
        """Home and away team of every order: two different teams of the same scope."""
        return self.table("orders").selectExpr(
            "o_orderkey AS match_key",
            "o_custkey AS home",
            f"(o_custkey + (o_orderkey % 7 + 1) * 10) % {self.team_count} AS away",
            "to_date(o_orderdate) AS odate",
            "o_orderstatus",
        )

    @cached_property
    def partidos(self) -> DataFrame:
        scores = self.table("lineitem").groupBy(F.col("l_orderkey").alias("match_key")).agg(
            F.expr(f"cast(sum(if(l_linenumber % 2 = 1, {GOALS}, 0)) as int)").alias("goles_local"),
            F.expr(f"cast(sum(if(l_linenumber % 2 = 1, 0, {GOALS})) as int)").alias("goles_visitante"),
        )
        return self._matches(self.pairings.join(scores, "match_key", "left"), "goles_local", "goles_visitante")

    @cached_property
    def calendario(self) -> DataFrame:
        """Matches without their scores, for which the order lines are not read."""
        return self._matches(self.pairings)

    @staticmethod
    def _matches(pairings: DataFrame, *scores: str) -> DataFrame:
        return pairings.selectExpr(
            "match_key AS id",
            f"{COMPETITION_ID}L AS competencia_id",
            f"if(match_key >= 0, {SEASON_ID}L, 0L) AS temporada_id",
            "odate AS fecha",
            f"{_time('match_key')} AS hora",
            "if(match_key % 17 <> 0, cast(match_key % 30 + 1 as int), NULL) AS jornada",
            "home AS local_equipo_id",
            "away AS visitante_equipo_id",
            "CASE o_orderstatus WHEN 'F' THEN 'finalizado' WHEN 'O' THEN 'programado' END AS estado",
            *scores,
            "cast(NULL as string) AS observaciones",
            "concat('https://liga.example/f/', match_key) AS programacion_url",
            "concat('https://liga.example/f/', match_key, '.pdf') AS programacion_pdf_url",
            "if(match_key % 6 = 0, 'reprogramacion', 'fecha_normal') AS tipo_fuente",
            f"nullif({pick(SHEET_LINKS, 'match_key')}, '') AS planilla_url",
            "if(match_key % 3 = 0, concat('https://video.example/', match_key), NULL) AS video_url",
            "timestamp'1999-01-01 00:00:00' AS updated_at",
        )

    @cached_property
    def match_lines(self) -> DataFrame:
        """Order lines beside the teams of their match."""
        pairs = self.pairings.selectExpr("match_key AS l_orderkey", "home", "away")
        return self.table("lineitem").join(pairs, "l_orderkey")

    @cached_property
    def participaciones(self) -> DataFrame:
        return self.match_lines.selectExpr(
            "l_orderkey * 8 + l_linenumber AS id",
            "l_orderkey AS partido_id",
            "l_partkey AS jugador_id",
            "if(l_linenumber % 2 = 1, home, away) AS equipo_id",
            f"{GOALS} AS goles",
            "l_linenumber % 3 AS exclusiones_2min",
            "if(l_returnflag = 'R', 1, 0) AS tarjeta_amarilla",
            "if(l_quantity > 48, 1, 0) AS tarjeta_roja",
            "if(l_returnflag = 'A', l_linenumber, NULL) AS asistencias",
            f"if(l_returnflag <> 'N', {GOALS} + l_linenumber, NULL) AS lanzamientos",
            "cast(NULL as int) AS atajadas",
            "if(l_linenumber % 4 = 0, l_linenumber + 60, NULL) AS dorsal_utilizado",
        )

    @cached_property
    def planteles(self) -> DataFrame:
        """Every (player, team) seen on a line, but for one in eleven."""
        seen = self.participaciones.select("jugador_id", "equipo_id").where("(jugador_id + equipo_id) % 11 <> 0")
        cases = " ".join(f"WHEN '{kind}' THEN '{position}'" for kind, position in POSITION_OF_TYPE.items())
        types = self.table("part").selectExpr("p_partkey AS jugador_id", f"CASE p_type {cases} ELSE '' END AS posicion")
        return (
            # Dealt by the player alone: that serves the join after as well.
            seen.repartition("jugador_id").distinct()
            .join(types, "jugador_id")
            .selectExpr(
                f"jugador_id * {self.team_count} + equipo_id AS id",
                "jugador_id",
                "equipo_id",
                "if(jugador_id % 13 <> 0, cast(jugador_id % 99 + 1 as int), NULL) AS dorsal",
                "posicion",
            )
        )

    @cached_property
    def participaciones_ajenas(self) -> DataFrame:
        """Player lines of which every third names another team, which nearly always did not play."""
        return self.participaciones.withColumn("equipo_id", F.expr("if(id % 3 = 0, equipo_id + 1, equipo_id)"))

    @cached_property
    def partidos_sin_jugar(self) -> DataFrame:
        """Matches before every seventh club has played: those of its teams have no score yet."""
        idle = "(local_equipo_id div 4 % 7 = 0 OR visitante_equipo_id div 4 % 7 = 0)"
        return self.partidos.withColumns({c: F.expr(f"if({idle}, NULL, {c})") for c in ("goles_local", "goles_visitante")})

    @cached_property
    def partidos_previos(self) -> DataFrame:
        """Matches as stored before an import: of every second one the sides are the other way round, so that the published
        match-up is new."""
        turned = {"local_equipo_id": "visitante_equipo_id", "visitante_equipo_id": "local_equipo_id"}
        return self.partidos.withColumns({own: F.expr(f"if(id % 2 = 0, {own}, {other})") for own, other in turned.items()})

    @cached_property
    def equipos_sin_lhd(self) -> DataFrame:
        """Teams of a federation without a women's top division: it goes by another honour division's name."""
        return self.equipos.withColumn("division", F.expr("if(rama = 'F' AND division LIKE 'LHD%', 'Liga de Honor B', division)"))

    @property
    def raw(self) -> dict[str, DataFrame]:
        names = ("clubes", "equipos", "jugadores", "planteles", "partidos", "participaciones")
        return {name: getattr(self, name) for name in names}

    @cached_property
    def partidos_defectuosos(self) -> DataFrame:
        """Matches with every kind of defect the checks look for."""
        changed = {
            "visitante_equipo_id": f"CASE WHEN id % 97 = 0 THEN (visitante_equipo_id + 1) % {self.team_count} "
            "WHEN id % 193 = 0 THEN local_equipo_id WHEN id % 211 = 0 THEN -1 ELSE visitante_equipo_id END",
            "goles_visitante": "if(id % 101 <> 0, goles_visitante, NULL)",
            "tipo_fuente": "if(id % 89 = 0, 'otro', tipo_fuente)",
            "programacion_url": "if(id % 83 = 0, ' ', programacion_url)",
            "competencia_id": "if(id % 127 = 0, 9L, competencia_id)",
            "temporada_id": "CASE WHEN id % 131 = 0 THEN 2L WHEN id % 137 = 0 THEN 8L ELSE temporada_id END",
        }
        damaged = self.partidos.withColumns({name: F.expr(text) for name, text in changed.items()})
        return damaged.withColumn("_copy", F.expr("explode(sequence(1, if(id % 307 = 0, 2, 1)))")).drop("_copy")

    @cached_property
    def publicaciones(self) -> DataFrame:
        """Fixture feed: about four publications per match-up, half of them with resolved ids."""
        return self.match_lines.selectExpr(
            "l_orderkey * 8 + l_linenumber AS seq",
            "date_format(date_trunc('quarter', l_shipdate), 'yyyy-MM-dd') AS fecha",
            "CASE l_linenumber % 3 WHEN 1 THEN '18:00' WHEN 2 THEN '20:30:00' END AS hora",
            f"{pick(CATEGORIES, 'home')} AS categoria",
            f"if(l_orderkey % 409 = 0, '', {pick(DIVISIONS, 'home')}) AS division",
            "if(home % 2 = 0, 'M', 'f') AS rama",
            "concat('Club ', home div 4) AS local",
            "concat('CLUB  ', away div 4) AS visitante",
            f"{pick(CODES, 'home')} AS local_equipo_codigo",
            f"lower({pick(CODES, 'away')}) AS visitante_equipo_codigo",
            "CASE WHEN l_orderkey % 419 = 0 THEN 'otro' WHEN l_returnflag = 'R' THEN 'reprogramacion' "
            "ELSE 'fecha_normal' END AS tipo_fuente",
            "if(l_orderkey % 2 = 0 AND l_orderkey % 401 <> 0, home, NULL) AS local_equipo_id",
            "if(l_orderkey % 2 = 0, away, NULL) AS visitante_equipo_id",
        )

    @cached_property
    def lotes(self) -> DataFrame:
        """Import batches of up to five consecutive orders as JSON arrays; a few are broken on purpose."""
        rows = self.pairings.selectExpr(
            "match_key",
            "match_key div 5 AS batch_id",
            f"'{SEASON_ID}' AS temporada_id",
            f"if(match_key % 71 = 0, '9', '{COMPETITION_ID}') AS competencia_id",
            "cast(odate as string) AS fecha",
            f"if(match_key % 83 = 0, '25:00', {pick(TIMES, 'match_key + 1')}) AS hora",
            "cast(match_key % 30 + 1 as string) AS jornada",
            "cast(if(match_key % 61 = 0, away, home) as string) AS local_equipo_id",
            "cast(away as string) AS visitante_equipo_id",
            "concat('https://liga.example/n/', match_key) AS programacion_url",
            "if(match_key % 67 = 0, ' ', concat('https://liga.example/n/', match_key, '.pdf')) AS programacion_pdf_url",
            "CASE WHEN match_key % 73 = 0 THEN 'otro' WHEN match_key % 4 = 0 THEN 'reprogramacion' "
            "ELSE 'fecha_normal' END AS tipo_fuente",
            "'' AS observaciones",
        )
        fields = ", ".join(c for c in rows.columns if c not in ("match_key", "batch_id"))
        # Five consecutive keys at most meet in a batch.
        listed = F.expr(
            f"transform(sort_array(collect_list(struct(match_key, struct({fields}) AS r))), x -> x.r)"
        ).alias("rows")
        return rows.groupBy("batch_id").agg(listed).selectExpr(
            "batch_id",
            "CASE WHEN batch_id % 53 = 0 THEN '[]' WHEN batch_id % 59 = 0 THEN '{}' ELSE to_json(rows) END AS payload",
        )

    @cached_property
    def planillas(self) -> DataFrame:
        """Sheet text of every match, in three layouts; every 17th has a goal too many."""
        size = "cast(match_key % 4 as int) + 2"

        def name(side: str) -> str:
            code = pick(CODES, side)
            suffix = f"if({code} = 'A', '', concat(' · Equipo ', {code}))"
            return f"concat({_club_name(f'{side} div 4')}, {suffix})"

        def goals(offset: int) -> str:
            return f"((match_key * 7 + k * 3 + {offset}) % 6)"

        def lines(offset: int) -> str:
            player = f"((match_key * 13 + k * 29 + {offset}) % {self.player_count})"
            line = (
                f"concat_ws(' ', k, concat('Pérez ', {player}, ','), {pick(FIRST_NAMES, player)}, "
                f"if({goals(offset)} = 0, '-', cast({goals(offset)} as string)), if((match_key + k) % 5 = 0, '1', '-'), "
                "k % 3, '-', '-')"
            )
            return f"array_join(transform(sequence(1, {size}), k -> {line}), '\\n')"

        def total(offset: int) -> str:
            return f"aggregate(sequence(1, {size}), 0L, (t, k) -> t + {goals(offset)})"

        def header(side: str) -> str:
            periods = f"concat('Goles PT ', {side}_goals div 2, ' ST ', {side}_goals - {side}_goals div 2, ' PTE 0 STE 0 P 0')"
            return (
                f"CASE match_key % 3 WHEN 0 THEN concat({side}_name, ' ', {side}_goals) "
                f"WHEN 1 THEN concat_ws('\\n', {side}_name, {side}_goals, {periods}) "
                f"ELSE concat_ws('\\n', {side}_name, {periods}) END"
            )

        # Sheets cost much more to read than their matches' bytes tell: as many tasks as are asked for, whatever the bytes.
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        played = self.pairings.repartition(tasks, "match_key").selectExpr(
            "*", f"{name('home')} AS home_name", f"{name('away')} AS away_name",
            f"{total(0)} + if(match_key % 17 = 0, 1, 0) AS home_goals", f"{total(7)} AS away_goals",
        )
        scope = f"concat({pick(CATEGORIES, 'home')}, ' - ', {pick(DIVISIONS, 'home')})"
        parts = (
            "'Torneo Metropolitano\\r'", "'Fecha:'", "cast(odate as string)", "'Hora:'",
            f"coalesce({_time('match_key')}, '12:00:00')", "'Categoria - Division:'", scope, "'Equipo local'",
            header("home"), "'Equipo  visitante'", header("away"), "'Nº Local G TAm 2 TR TAz'", lines(0),
            "'A Ramos, Eva - - - -'", "'Nº Visitante G TAm 2 TR TAz'", lines(7), "'Arbitros'", "'1 Juez, Uno 9 - - - -'",
        )
        return played.selectExpr("cast(match_key as string) AS path", f"concat_ws('\\n', {', '.join(parts)}) AS text")

    @cached_property
    def respuestas(self) -> DataFrame:
        """Response log from the event stream."""
        return self.table("events").selectExpr(
            "cast(event_id as string) AS key",
            "concat('/', event_type) AS path",
            "element_at(array(200, 401, 404, 500), cast(event_id % 4 as int) + 1) AS status",
            "CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 20 = 4 THEN '<pre>Cannot GET /x</pre>' "
            "WHEN event_id % 20 = 8 THEN 'Missing Token' ELSE '<html>ok</html>' END AS body",
        )

    @cached_property
    def ajustes(self) -> DataFrame:
        """A point adjustment for every team, some of them invalid."""
        return self.table("customer").selectExpr(
            f"if(c_custkey % 45 <> 0, c_custkey, c_custkey + {self.team_count}) AS team_id",
            f"if(c_custkey % 63 = 0, 2L, {SEASON_ID}L) AS season_id",
            f"if(c_custkey % 81 <> 0, {COMPETITION_ID}L, NULL) AS competition_id",
            "cast(c_custkey % 7 as int) - 3 AS points_delta",
            "if(c_custkey % 99 <> 0, 'Resolución', NULL) AS reason",
            "if(c_custkey % 117 = 0, '  ', 'https://liga.example/res') AS official_source",
            "'1999-05-01' AS resolution_date",
        )
