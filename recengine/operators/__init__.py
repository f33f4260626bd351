"""recengine.operators"""
