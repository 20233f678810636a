"""trackloom: rail-geometry analytics over Spark tables of points, lines, tiles and pixels."""
