"""Revision analytics on Spark: releases, vintages, serving strategies, lineage and cost."""
