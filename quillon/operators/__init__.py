"""quillon.operators"""
