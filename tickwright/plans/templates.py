"""Question templates: which operators answer each intent."""

from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import ranges as R


def answer(intent: str, tables: dict, params: dict) -> dict:
    """Frames answering one resolved question.

    tables: prices, symbols, symbol_stats, latest_quote; params: start, end,
    limit, sector, symbols, metric, ordering. A stated metric replaces the sort of the
    template where the board can be sorted by it, a stated ordering its direction.
    """
    bars, symbols, stats = tables["prices"], tables["symbols"], tables["symbol_stats"]
    start, end = params["start"], params["end"]
    limit, sector = params.get("limit", 10), params.get("sector", "")
    chosen = list(params.get("symbols", ()))
    metric, ordering = params.get("metric", ""), params.get("ordering", "")

    def stated(sorts, sort, ascending):
        return (metric if metric in sorts else sort), ordering == "asc" if ordering else ascending

    def movers(sort, ascending):
        sort, ascending = stated(M.MOVER_SORTS, sort, ascending)
        return {"rows": M.period_movers_ranked(bars, symbols, start, end, sort, ascending, sector, limit),
                "breadth": M.market_breadth(
                    bars, symbols.filter(F.col("sector") == sector) if sector else symbols, start, end)}

    def board(sort, ascending):
        sort, ascending = stated(M.STATS_SORTS, sort, ascending)
        return {"rows": M.leaderboard_ranked(stats, sort, ascending, sector, limit)}

    def company():
        names = F.col("symbol").isin(chosen)
        return {"stats": M.window_stats(bars.filter(names), start, end),
                "quote": tables["latest_quote"].filter(names)}

    templates = {
        "top_volume": lambda: movers("volume", False),
        "biggest_winners": lambda: movers("return", False),
        "biggest_losers": lambda: movers("return", True),
        "biggest_drawdown": lambda: board("drawdown", True),
        "most_volatile": lambda: board("volatility", False),
        "safest": lambda: board("volatility", True),
        "best_cagr": lambda: board("cagr", False),
        "compare": lambda: {"series": R.indexed_comparison(bars, start, end, chosen),
                            "stats": M.window_stats(bars.filter(F.col("symbol").isin(chosen)), start, end)},
        "company_detail": company,
        "sector": lambda: {"rows": M.sector_performance(bars, symbols, start, end)},
        "market_summary": lambda: {
            "stats": M.window_stats(bars.join(symbols.filter("is_index = 1").select("symbol"),
                                              "symbol", "left_semi"), start, end),
            "breadth": M.market_breadth(bars, symbols, start, end)},
    }
    return templates[intent]()
